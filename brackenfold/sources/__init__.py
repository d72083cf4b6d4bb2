"""Part of brackenfold."""
