"""chartloom: document processing and evidence retrieval as Spark DataFrame plans."""
