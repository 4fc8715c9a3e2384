"""Reading data under a contract, and publishing it."""
