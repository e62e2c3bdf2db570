"""From a question to a plan and an answer: small decisions on the driver, the data work in Spark."""
