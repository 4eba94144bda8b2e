"""Schema-guided document extraction as Spark DataFrame operations; see loomspark.plans.engine."""
