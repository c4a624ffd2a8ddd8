"""Where tables come from: source trees."""
