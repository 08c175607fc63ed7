"""Ridgeline: analytics over semi-structured text and relations, as Spark DataFrame plans."""
