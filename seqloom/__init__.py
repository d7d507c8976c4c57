"""seqloom: protein and peptide sequence analytics as Spark DataFrame operators."""
