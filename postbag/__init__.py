"""Communication-network analytics on Spark: message threads to graphs, hypergraphs,
day slices and tensors, and the questions that one asks of them."""
