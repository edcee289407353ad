"""Layout and document-structure analytics as Spark DataFrame operators."""
