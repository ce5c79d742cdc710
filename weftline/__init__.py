"""weftline: analytics over archived web pages and text corpora, written for Spark."""
