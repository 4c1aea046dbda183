from .catalog import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
