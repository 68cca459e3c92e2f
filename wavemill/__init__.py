"""Wave-pattern analytics over OHLCV price bars, as Spark DataFrame operators."""
