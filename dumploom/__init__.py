"""Ingestion and analytics for plain-text PostgreSQL dumps, on Spark."""
