"""Training-data operators: one module per operator, general interface first, registered query last."""
