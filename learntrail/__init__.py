"""learntrail: analytics over logs of learning attempts, as Spark DataFrame operators."""
