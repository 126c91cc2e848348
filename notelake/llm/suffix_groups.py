"""Suffix sorting by Lyndon groups: linear grouping, without recursion or renaming.

Phase 1 puts suffixes in groups that share a prefix and takes the groups in descending order. For a group, each member's
previous smaller pointer leads to the nearest earlier suffix of a lower group; that suffix's prefix now goes on with
the member's, so it moves to a new group right above its old one, the further the more members lead to it. In the end a
group holds the suffixes with one Lyndon prefix.

Phase 2 fills the order from the front: the suffix before the one at hand, and those that its previous smaller pointers
lead to, take the next places of their groups until one has its place already.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The order of the suffixes of a list of numbers; a suffix that is a prefix of another comes before it."""
    n = len(text)
    if not n:
        return []
    initial: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        initial.setdefault(c, []).append(i)
    # group 0 bounds the chain from above and below; members keeps those that have moved on until the group's turn
    members: list[list[int]] = [[]]
    size, above, below = [0], [0], [0]
    of = [0] * n

    def insert(group: list[int], lower: int) -> int:
        g, upper = len(members), above[lower]
        members.append(group)
        size.append(len(group))
        above.append(upper)
        below.append(lower)
        above[lower] = below[upper] = g
        for i in group:
            of[i] = g
        return g

    top = 0
    for c in sorted(initial):
        top = insert(initial[c], top)
    done, before = bytearray(n), [-1] * n
    g = top
    while g:
        group = members[g]
        if len(group) != size[g]:
            group = members[g] = [i for i in group if of[i] == g]
        if len(group) == 1:
            i = group[0]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0 and size[of[p]] > 1:
                lower = of[p]
                size[lower] -= 1
                upper, new = above[lower], len(members)
                members.append([p])
                size.append(1)
                above.append(upper)
                below.append(lower)
                above[lower] = below[upper] = of[p] = new
            g = below[g]
            continue
        for i in group:
            done[i] = 1
        # members come in order of place, so those that lead to one suffix are neighbours
        leads: list[int] = []
        counts: list[int] = []
        last = -1
        for i in group:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p < 0:
                continue
            if p == last:
                counts[-1] += 1
            else:
                leads.append(p)
                counts.append(1)
                last = p
        if len(leads) == 1:
            p = leads[0]
            old = of[p]
            if size[old] > 1:
                size[old] -= 1
                insert([p], old)
        elif leads:
            lots: dict[tuple[int, int], list[int]] = {}
            for p, k in zip(leads, counts):
                key = (of[p], k)
                if key in lots:
                    lots[key].append(p)
                else:
                    lots[key] = [p]
            lower, was = 0, 0
            for key in sorted(lots) if len(lots) > 1 else lots:
                old, moved = key[0], lots[key]
                if len(moved) == size[old] and old != was:  # the group goes on as it is
                    continue
                if old != was:
                    lower, was = old, old
                size[old] -= len(moved)
                lower = insert(moved, lower)
        g = below[g]

    # ascending groups and where each begins
    start = [0] * len(members)
    at, g = 0, above[0]
    while g:
        start[g] = at
        at += size[g]
        g = above[g]
    order = [0] * n
    placed = bytearray(n)
    i = n
    at = 0
    while True:
        s = i - 1
        while s >= 0 and not placed[s]:
            g = of[s]
            order[start[g]] = s
            start[g] += 1
            placed[s] = 1
            s = before[s]
        if at == n:
            return order
        i = order[at]
        at += 1
