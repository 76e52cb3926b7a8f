"""Analytics over source trees, document collections and event logs, as Spark plans."""
