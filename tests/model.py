"""A sequential model of the graph, for tests: edges, order, flags, common suffixes, degrees and unitigs."""

COMPLEMENT = str.maketrans("acgt", "tgca")


def edges(kmers, k, revcomps):
    e = set(kmers)
    if revcomps:
        e |= {x[::-1].translate(COMPLEMENT) for x in e}
    starts, ends = {x[:-1] for x in e}, {x[1:] for x in e}
    rows = {(x[:-1], x[-1], "standard") for x in e} | {(s, "$", "out_dummy") for s in ends - starts}
    rows |= {("$" * (k - n) + s[: n - 1], s[n - 1], "in_dummy") for s in starts - ends for n in range(1, k)}
    rows = sorted(rows, key=lambda r: (r[0][::-1], r[1]))
    out, seen, prev, node_id = [], set(), None, -1
    for pos, (node, w, tag) in enumerate(rows):
        lcs = 0
        if prev is not None:
            while lcs < k - 1 and node[-1 - lcs] == prev[-1 - lcs] and node[-1 - lcs] != "$":
                lcs += 1
            lcs = k - 1 if node == prev else lcs
        first = node != prev
        node_id += first
        leads = w == "$" or (node[1:], w) not in seen
        seen.add((node[1:], w))
        out.append({"pos": pos, "node_id": node_id, "node": node, "w": w, "tag": tag, "node_first": int(first), "end_first": int(leads), "lcs": lcs})
        prev = node
    return out


def unitigs(kmers, k):
    e = sorted(set(kmers), key=lambda x: (x[:-1][::-1], x[-1]))
    into, out = {}, {}
    for x in e:
        out.setdefault(x[:-1], []).append(x)
        into.setdefault(x[1:], []).append(x)
    nxt = {into[n][0]: out[n][0] for n in out if len(out[n]) == 1 and len(into.get(n, [])) == 1}
    heads, found, used = [x for x in e if x not in set(nxt.values())], set(), set()

    def walk(x, cycle):
        chain = [x]
        while chain[-1] in nxt and nxt[chain[-1]] != x:
            chain.append(nxt[chain[-1]])
        used.update(chain)
        found.add((x, len(chain), x[:-1] + "".join(c[-1] for c in chain), cycle))

    for x in heads:
        walk(x, False)
    for x in e:
        if x not in used:
            walk(x, True)
    return found
