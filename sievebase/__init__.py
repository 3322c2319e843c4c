"""Source-repository analytics as Spark DataFrames: findings, scores, dashboards."""
