"""Decision analytics on Spark: causal effects, beliefs, guardrails, routing and workflows over whole tables."""
