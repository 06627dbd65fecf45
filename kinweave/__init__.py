"""Haplotype-sharing analytics and corpus preparation as Spark jobs."""
