"""What a model reads at once."""

from __future__ import annotations

from collections.abc import Sequence

#: Tokens that a model reads at most; of a pair, the query's share.
WINDOW = 512
QUERY_TOKENS = 128


def fitted_pair(query: Sequence[int], passage: Sequence[int], window: int = WINDOW, special: int = 3) -> tuple[list[int], list[int]]:
    """Tokens of a pair cut to a window: the query to a quarter of it, at most QUERY_TOKENS, the passage to the rest."""
    q = list(query[: min(QUERY_TOKENS, window // 4)])
    return q, list(passage[: max(0, window - special - len(q))])


def check_window(count: int, what: str, window: int = WINDOW) -> None:
    if count > window:
        raise ValueError(f"{what} has {count} tokens; the model reads {window}")
