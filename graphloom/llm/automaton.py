"""Online generalised suffix automaton over word sequences."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of the sequences fed so far. Two states a word at most."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.words = 0

    def _clone(self, p: int, q: int, word) -> int:
        """Splits off state q what is one longer than p, and leads p and its suffixes there."""
        clone = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        step = self.next
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = clone
            p = self.link[p]
        return clone

    def feed(self, words) -> list[int]:
        """Adds a sequence. For each word the matching statistic: how many words, up to and with this one, also
        stood somewhere in the text fed before (earlier sequences, or this one up to the word before)."""
        step, link, length = self.next, self.link, self.length
        last, seen = 0, []
        for word in words:
            q = step[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, word)
                seen.append(length[last])
                continue
            new = len(link)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and word not in step[p]:
                step[p][word] = new
                p = link[p]
            if p >= 0:
                q = step[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
            last = new
            seen.append(length[link[new]])
        self.words += len(seen)
        return seen

    def statistics(self, words) -> list[int]:
        """For each word of a sequence, how many words up to and with it stand somewhere in the text fed. Adds nothing."""
        step, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                n = length[state]
            if word in step[state]:
                state = step[state][word]
                n += 1
            out.append(n)
        return out
