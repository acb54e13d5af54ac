"""All places of many patterns in a text in one pass: an automaton of the patterns' beginnings.

A state is a beginning of some patterns. ``goto`` leads from it by the next character, ``fail`` to its longest proper end that is a
beginning as well, and ``output`` to the nearest state along these ends that is a whole pattern.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator


class Automaton:
    def __init__(self, patterns: list[str]) -> None:
        """Empty patterns are nowhere."""
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, pattern in enumerate(patterns):
            state = 0
            for c in pattern:
                following = self.goto[state].get(c)
                if following is None:
                    following = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.ends.append([])
                state = following
            if state:
                self.ends[state].append(k)
        self.fail, self.output = [0] * len(self.goto), [0] * len(self.goto)
        waiting = deque(self.goto[0].values())
        while waiting:
            state = waiting.popleft()
            for c, following in self.goto[state].items():
                back = self.fail[state]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                shorter = self.goto[back].get(c, 0) if following != self.goto[0].get(c) else 0
                self.fail[following] = shorter
                self.output[following] = shorter if self.ends[shorter] else self.output[shorter]
                waiting.append(following)

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(number of the pattern, end of the place) of every place, overlaps included, in the order of ends."""
        goto, fail, ends, output = self.goto, self.fail, self.ends, self.output
        state = 0
        for at, c in enumerate(text, 1):
            while state and c not in goto[state]:
                state = fail[state]
            state = goto[state].get(c, 0)
            hit = state if ends[state] else output[state]
            while hit:
                for k in ends[hit]:
                    yield k, at
                hit = output[hit]

    def once(self, text: str, patterns: int) -> list[int | None]:
        """Of each pattern the end of its only place, 0 where it is nowhere, None where it is more than once."""
        found: list[int | None] = [0] * patterns
        for k, at in self.places(text):
            found[k] = at if found[k] == 0 else None
        return found
