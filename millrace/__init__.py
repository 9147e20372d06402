"""millrace: event, session and anomaly analytics as Spark DataFrame plans."""
