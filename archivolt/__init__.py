"""Analytics over large, changing document archives, as Spark DataFrame transformations."""
