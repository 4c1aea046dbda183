from .frame import Frame, Handle

__all__ = ["Frame", "Handle"]
