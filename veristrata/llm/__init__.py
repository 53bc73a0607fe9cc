"""Training-data operators (op1..op10). Nothing outside this subpackage imports it."""
