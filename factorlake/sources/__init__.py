"""Tables read and derived, and what is wrong with them."""
