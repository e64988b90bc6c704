"""strandloom: DataFrame-first analytics for genomic files, plus training-data operators in the subpackage llm."""
