"""What a graph holds: statistics in Spark, and the cards, paths and slices made of them on the driver."""
