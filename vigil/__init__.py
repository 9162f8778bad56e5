"""vigil: moderation analytics as Spark DataFrame operators."""
