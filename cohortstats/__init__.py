"""cohortstats: cohort statistics and federated-style learning as Spark plans."""
