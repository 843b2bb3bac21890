"""FASTA files and the preprocessed sequence database."""
