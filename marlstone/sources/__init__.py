from .archive import Archive, Binary, Staged
from .types import BOOL, CHAR, F32, F64, STRING, Int, NonZero, Opt, Seq, schema_of

__all__ = ["Archive", "BOOL", "Binary", "CHAR", "F32", "F64", "Int", "NonZero", "Opt", "STRING", "Seq", "Staged", "schema_of"]
