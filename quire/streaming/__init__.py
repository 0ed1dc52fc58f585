"""The live flows as Structured Streaming queries.

Flows that are projections or keyed aggregates run the batch operators on a
stream unchanged.  Flows with order-dependent state run the same state objects
as the batch folds, one micro-batch at a time.
"""
