"""Which tokens of a merge table may stand side by side.

A merge table joins the adjacent pair whose joined text comes first in the table, leftmost first on ties.
Two tokens may be neighbours if no merge ever crosses their border. Only the parts that touch the border
matter: on the left the token, its right half, that one's right half and so on; on the right the same with
left halves. Each such part lives from the time it is formed until its parent is, so a crossing merge takes
place just when both parts live at its time.
"""

from __future__ import annotations

NEVER = float("inf")


class Merges:
    """order: joined text -> time of its merge (less is earlier). Single characters need no entry."""

    def __init__(self, order: dict[str, float], pairs_kept: int = 400_000):
        self.order, self.pairs_kept = order, pairs_kept
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}

    def split(self, token: str) -> tuple[str, str] | None:
        """The two parts of the token's last merge; None for a character or a text that doesn't merge into one."""
        if token not in self.halves:
            parts, order, last = list(token), self.order, None
            while len(parts) > 1:
                best, at = min((order.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == NEVER:
                    last = None
                    break
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = last
        return self.halves[token]

    def whole(self, token: str) -> bool:
        return len(token) == 1 or self.split(token) is not None

    def _edge(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """(part, formed, ended) of the parts at the token's border, the token first."""
        ended, out = NEVER, []
        while True:
            formed = self.order.get(token, -1.0) if len(token) > 1 else -1.0
            out.append((token, formed, ended))
            if len(token) == 1:
                return out
            token, ended = self.split(token)[side], formed

    def compatible(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.whole(left) and self.whole(right) and not self._crossed(left, right)
            if len(self.pairs) >= self.pairs_kept:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _crossed(self, left: str, right: str) -> bool:
        order, ends = self.order, self._edge(right, 0)
        for a, formed_a, ended_a in self._edge(left, 1):
            for b, formed_b, ended_b in ends:
                joined = order.get(a + b)
                if joined is not None:
                    at = max(joined, formed_a, formed_b)
                    if at < ended_a and at <= ended_b:
                        return True
        return False
