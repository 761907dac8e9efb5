"""ledgerfold: fold child ledgers into one feature row per entity, profile,
split, train, threshold and score -- all as Spark DataFrame plans."""

__version__ = "0.1.0"
