"""webloom: DataFrame operators for crawled-web corpora on Apache Spark."""
