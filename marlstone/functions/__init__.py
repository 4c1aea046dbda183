from .predicates import Predicate, all_, always, any_, eq, is_none, is_some, mask, ne, none_of, one_of, range_, where_, xor_

__all__ = ["Predicate", "all_", "always", "any_", "eq", "is_none", "is_some", "mask", "ne", "none_of", "one_of", "range_", "where_", "xor_"]
