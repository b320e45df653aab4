"""Reading sources, contracts and adapter views; writing marts."""
