"""stateflux: state-sequence analytics expressed as Spark DataFrame plans."""
