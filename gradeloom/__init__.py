"""Analytics over graded agent conversations, as Spark plans."""
