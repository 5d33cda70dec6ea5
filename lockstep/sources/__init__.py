"""Manifests, FASTA files, string columns and the shared folder."""
