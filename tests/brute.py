"""The counting rules, word for word, over Python lists."""


def count(tokens, node, window, minfreq):
    node = node.split()
    n, size = len(node), len(tokens)
    starts = [i for i in range(size - n + 1) if tokens[i : i + n] == node]
    ctx, own, windows = set(), set(), []
    for p in starts:
        near = set(range(max(0, p - window), p)) | set(range(p + n, min(size, p + n + window)))
        ctx |= near
        own |= set(range(p, p + n))
        windows.append({tokens[i] for i in near})
    out = [tokens[i] for i in range(size) if i not in ctx and i not in own]
    a = {}
    for i in ctx:
        a[tokens[i]] = a.get(tokens[i], 0) + 1
    a = {w: x for w, x in a.items() if x >= minfreq}
    rest = sum(1 for w in out if w not in a)
    return {w: (x, len(starts) - sum(w in s for s in windows), out.count(w), rest - out.count(w)) for w, x in a.items()}


def corpus(docs, node, window, minfreq):
    total = {}
    for tokens in docs:
        for w, cells in count(tokens, node, window, 1).items():
            old = total.get(w, (0, 0, 0, 0, 0))
            total[w] = tuple(x + y for x, y in zip(old, (*cells, 1), strict=True))
    return {w: x for w, x in total.items() if x[0] >= minfreq}
