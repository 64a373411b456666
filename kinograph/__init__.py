"""kinograph: dense frame, time-series and corpus analytics as Spark plans."""
