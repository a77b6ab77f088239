"""Trade-document and stock-ledger analytics as Spark DataFrame operators."""
