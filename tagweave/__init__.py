"""Tagged-record, time-series, graph and text analytics as Spark plans."""
