"""Corvane: a DataFrame-first engine for corpus analytics and entity resolution on Spark."""
