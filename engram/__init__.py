"""engram: conversational-memory analytics as pure DataFrame -> DataFrame operators."""
