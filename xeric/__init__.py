"""xeric: drought and hydro-climatic analytics expressed as Spark DataFrame operators."""
