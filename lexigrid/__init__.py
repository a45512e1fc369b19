"""lexigrid: ranked n-gram analytics as declarative Spark plans."""
