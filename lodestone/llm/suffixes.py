"""Suffix arrays of many small texts at once, by linear grouping.

Each text is an *instance*; all advance in step, so a step's work is one pass of
array operations over every instance, whatever their number.

Phase 1 starts from groups of suffixes with the same first symbol and takes the groups in
descending order. A suffix's previous smaller pointer leads to the last place before it
whose group is lower. The suffixes that pointers of the current group lead to have a longer
Lyndon prefix than was known; they leave their group for new ones right above it,
ordered by how many pointers lead to them. In the end a group holds the suffixes
with one Lyndon prefix, and groups stand in order.

Phase 2 reads the array from the left: the suffix before the one just read, and those along
its previous smaller pointers, take the next free places of their groups, until one is
placed already. No symbol is renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np

from lodestone.llm.textbytes import ragged


def suffix_arrays(symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places in ``symbols`` of all suffixes, each instance's in order.

    ``symbols``: the instances one after another, ``lens`` of each; numbers from 1,
    the last symbol of an instance being 0, its only 0.
    """
    lens = np.asarray(lens, np.int64)
    k = len(lens)
    # one guard cell before each instance, lower than every group
    base = np.cumsum(lens + 1) - lens
    inside = ragged(base, lens)
    total = int(lens.sum()) + k
    text = np.zeros(total, np.int64)
    text[inside] = symbols
    owner = np.repeat(np.arange(k), lens)
    order = np.lexsort((text[inside], owner))
    sa = np.full(total, -1, np.int64)
    sa[inside] = inside[order]
    at = np.full(total, -1, np.int64)
    at[sa[inside]] = inside
    key = text[sa[inside]]
    head = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(inside) else np.zeros(0, bool)
    group = np.full(total, -1, np.int64)  # of a suffix: the first slot of its group
    starts = inside[head]
    group[sa[inside]] = starts[np.cumsum(head) - 1]
    size = np.zeros(total, np.int64)
    size[starts] = np.diff(np.r_[np.flatnonzero(head), len(inside)])
    prev = np.arange(total) - 1
    moved = np.zeros(total, bool)

    cur = base + lens  # the slot after the next group
    act = np.arange(k)
    while len(act):
        end = cur[act]
        start = group[sa[end - 1]]
        mem = sa[ragged(start, end - start)]
        own = group[mem]
        todo = np.arange(len(mem))
        while len(todo):
            q = prev[mem[todo]]
            high = group[q] >= own[todo]
            todo, q = todo[high], q[high]
            prev[mem[todo]] = prev[q]
        into = prev[mem]
        into = into[group[into] >= 0]
        if len(into):
            j, times = np.unique(into, return_counts=True)
            old = group[j]
            o = np.lexsort((times, old))
            j, times, old = j[o], times[o], old[o]
            first = np.r_[True, old[1:] != old[:-1]]
            where = np.flatnonzero(first)
            count = np.diff(np.r_[where, len(j)])
            low = old[where] + size[old[where]] - count  # first slot of those that move
            slots = ragged(low, count)
            moved[j] = True
            there = sa[slots]
            stay = there[~moved[there]]
            was = at[j]
            left = was[was < np.repeat(low, count)]
            sa[left], at[stay] = stay, left
            sa[slots], at[j] = j, slots
            moved[j] = False
            size[old[where]] -= count
            sub = np.flatnonzero(first | np.r_[True, times[1:] != times[:-1]])
            width = np.diff(np.r_[sub, len(j)])
            group[j] = np.repeat(slots[sub], width)
            size[slots[sub]] = width
        cur[act] = start
        act = act[start > base[act]]

    out = np.full(total, -1, np.int64)
    free = group.copy()  # of a group's first slot: its next free slot
    free[:] = np.arange(total)
    placed = np.zeros(total, bool)
    placed[base - 1] = True  # the guards
    last = base + lens - 1
    out[base], placed[last] = last, True
    step = 0
    act = np.arange(k)
    while len(act := act[lens[act] > step]):
        j = out[base[act] + step] - 1
        while len(j := j[~placed[j]]):
            slot = free[group[j]]
            out[slot], placed[j] = j, True
            free[group[j]] = slot + 1
            j = prev[j]
        step += 1
    found = out[inside]
    return found - (np.repeat(np.arange(k), lens) + 1)  # without the guard cells
