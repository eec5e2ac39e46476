"""The pair key: a conversation and the turn of the pair's second sentence.

It is the key the pairing joins on, so rows that leave the join are already
partitioned by it and every per-pair grouping stays in place.
"""

PAIR = ("conv_id", "turn")
