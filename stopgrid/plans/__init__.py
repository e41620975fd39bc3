"""How plans are cut, spread and stored."""
