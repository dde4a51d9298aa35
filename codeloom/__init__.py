"""codeloom: code-quality and review-queue analytics as Spark DataFrame operators."""
