"""Where artifacts and changes come from."""
