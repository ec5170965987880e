"""tidemill: message-flow analytics expressed as Spark DataFrame plans."""
