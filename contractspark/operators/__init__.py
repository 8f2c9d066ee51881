"""DataFrame-to-DataFrame operators. They return lazy plans unless their docstring names an action."""
