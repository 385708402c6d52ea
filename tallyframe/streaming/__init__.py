"""Extensions for statements that keep arriving."""
