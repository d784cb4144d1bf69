"""Plans composed of operators: rules to decisions to kept spans."""
