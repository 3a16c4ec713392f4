"""Streaming: applying a fitted feature pipeline and model to a stream.

The reference has no streaming (its "stream" is control-flow events).  The only
streaming use that follows from its operators is scoring new rows with the
saved preprocessing + model, which works unchanged on a ``readStream``
DataFrame because every fitted step is a Column expression or a stream–static
join (frequency maps, TF-IDF vocabulary).
"""
