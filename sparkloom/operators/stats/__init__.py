"""Statistics as column expressions, small plans and, where no built-in operator can say it, blocked pandas."""
