"""Slow versions of kernels, written from their definitions and sharing no code with them."""

import math
import re


def jpeg(data):
    """Rows of (r, g, b) of a JPEG, bit by bit and with the cosine sums of the standard."""
    zigzag = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
    at, tables, quant, restart, comps, blocks = 2, {}, {}, 0, {}, {}
    while data[at + 1] != 0xD9:
        mark, size = data[at + 1], data[at + 2] * 256 + data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            quant[body[0] & 15] = list(body[1:65])
        elif mark == 0xDD:
            restart = body[0] * 256 + body[1]
        elif mark == 0xC4:
            code, k, table = 0, 17, {}
            for n in range(1, 17):
                for _ in range(body[n]):
                    table[format(code, f"0{n}b")] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0]] = table
        elif mark == 0xC2:
            height, width = body[1] * 256 + body[2], body[3] * 256 + body[4]
            comps = {body[6 + 3 * k]: (body[7 + 3 * k] // 16, body[7 + 3 * k] % 16, body[8 + 3 * k]) for k in range(body[5])}
        elif mark == 0xDA:
            end = at
            while data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 1
            raw, parts = data[at:end], [[]]
            k = 0
            while k < len(raw):
                if raw[k] == 0xFF and raw[k + 1] != 0:
                    parts.append([])
                    k += 2
                    continue
                parts[-1].append(format(raw[k], "08b"))
                k += 2 if raw[k] == 0xFF else 1
            at = end
            n = body[0]
            chosen = [(body[1 + 2 * k], tables.get(body[2 + 2 * k] // 16), tables.get(16 + body[2 + 2 * k] % 16)) for k in range(n)]
            _scan(iter(["".join(p) for p in parts]), chosen, body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] // 16, body[3 + 2 * n] % 16, comps, height, width, restart, blocks)
    hm, vm = max(c[0] for c in comps.values()), max(c[1] for c in comps.values())
    basis = [[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for u in range(8)] for x in range(8)]
    planes = []
    for c, (h, v, q) in comps.items():
        plane = {}
        for (c2, by, bx), z in blocks.items():
            if c2 != c:
                continue
            f = [0] * 64
            for k in range(64):
                f[zigzag[k]] = z[k] * quant[q][k]
            half = [[sum(basis[x][u] * f[8 * w + u] for u in range(8)) for x in range(8)] for w in range(8)]
            for y in range(8):
                for x in range(8):
                    plane[by * 8 + y, bx * 8 + x] = min(255, max(0, round(128 + sum(basis[y][w] * half[w][x] for w in range(8)))))
        planes.append((h, v, plane))
    out = []
    for y in range(height):
        row = []
        for x in range(width):
            a, b, c = (p[y * v // vm, x * h // hm] for h, v, p in planes)
            rgb = (a + 1.402 * (c - 128), a - 0.344136 * (b - 128) - 0.714136 * (c - 128), a + 1.772 * (b - 128))
            row.append(tuple(min(255, max(0, round(s))) for s in rgb))
        out.append(row)
    return out


def _scan(segments, chosen, ss, se, ah, al, comps, height, width, restart, blocks):
    hm, vm = max(c[0] for c in comps.values()), max(c[1] for c in comps.values())
    if len(chosen) > 1:
        units = [[(c, dc, ac, my * comps[c][1] + y, mx * comps[c][0] + x) for c, dc, ac in chosen for y in range(comps[c][1]) for x in range(comps[c][0])] for my in range(math.ceil(height / 8 / vm)) for mx in range(math.ceil(width / 8 / hm))]
    else:
        c, dc, ac = chosen[0]
        units = [[(c, dc, ac, y, x)] for y in range(math.ceil(math.ceil(height * comps[c][1] / vm) / 8)) for x in range(math.ceil(math.ceil(width * comps[c][0] / hm) / 8))]
    state = {}

    def bits(n):
        state["at"] += n
        return int(state["bits"][state["at"] - n : state["at"]] or "0", 2) if n else 0

    def symbol(table):
        n = 1
        while state["bits"][state["at"] : state["at"] + n] not in table:
            n += 1
        state["at"] += n
        return table[state["bits"][state["at"] - n : state["at"]]]

    def value(n):
        v = bits(n)
        return v if n == 0 or v >= 2 ** (n - 1) else v - 2**n + 1

    for k, unit in enumerate(units):
        if k == 0 or restart and k % restart == 0:
            state = {"bits": next(segments), "at": 0, "run": 0, "dc": {}}
        for c, dc, ac, y, x in unit:
            b = blocks.setdefault((c, y, x), [0] * 64)
            if ss == 0 and ah == 0:
                state["dc"][c] = state["dc"].get(c, 0) + value(symbol(dc))
                b[0] = state["dc"][c] * 2**al
            elif ss == 0:
                b[0] += bits(1) * 2**al if b[0] >= 0 else bits(1) * 2**al
            elif ah == 0:
                _first(b, ss, se, al, state, bits, symbol, value, ac)
            else:
                _again(b, ss, se, al, state, bits, symbol, ac)


def _first(b, ss, se, al, state, bits, symbol, value, ac):
    if state["run"]:
        state["run"] -= 1
        return
    k = ss
    while k <= se:
        r, s = divmod(symbol(ac), 16)
        if s == 0 and r < 15:
            state["run"] = 2**r + bits(r) - 1
            return
        k += r
        if s:
            b[k] = value(s) * 2**al
        k += 1


def _again(b, ss, se, al, state, bits, symbol, ac):
    def correct(k):
        if bits(1):
            b[k] += 2**al if b[k] > 0 else -(2**al)

    k = ss
    while k <= se and not state["run"]:
        r, s = divmod(symbol(ac), 16)
        new = (2**al if bits(1) else -(2**al)) if s else 0
        if s == 0 and r < 15:
            state["run"] = 2**r + bits(r)
            break
        while k <= se:
            if b[k]:
                correct(k)
            elif r == 0:
                b[k] = new
                k += 1
                break
            else:
                r -= 1
            k += 1
    if state["run"]:
        for j in range(k, se + 1):
            if b[j]:
                correct(j)
        state["run"] -= 1


def gram(data, n, bits):
    """Bucket of the n bytes at the start of `data`, zeros behind its end."""
    code = int.from_bytes((bytes(data[:n]) + bytes(n))[:n], "big") * 0x9E3779B1 & 0xFFFFFFFF
    code ^= code >> 15
    return (code * 0x85EBCA77 & 0xFFFFFFFF) >> 32 - bits


def gram_means(data, table, n, bits):
    """Mean of the table's rows over all positions of `data`."""
    total = [0.0] * table.shape[1]
    rows = table.tolist()
    for i in range(len(data)):
        for c, v in enumerate(rows[gram(data[i : i + n], n, bits)]):
            total[c] += v
    return [x / max(1, len(data)) for x in total]


def language(model, text, margin, n, bits):
    """(language, margin) by the family's machine, then by the votes of its pairs."""
    if not re.search(r"[^\W\d_]", text or ""):
        return "und", 0.0
    low = "".join(c.lower() if ord(c) < 256 else c for c in text).encode()
    data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low)
    score = {m: s + b for m, s, b in zip(model.machines, gram_means(data, model.table, n, bits), model.bias)}
    families = sorted(model.members)
    if len(families) == 2:
        top = score["", families[0], families[1]]
        family, sure = families[0 if top >= 0 else 1], abs(top)
    else:
        ranked = sorted(families, key=lambda f: -score["", f, ""])
        family, sure = ranked[0], (score["", ranked[0], ""] - score["", ranked[1], ""]) / 2
    votes = {}
    for (where, a, b), s in score.items():
        if where == family:
            for lang, v in ((a, s), (b, -s)):
                votes.setdefault(lang, []).append(v)
    if votes:
        best = max(sorted(votes), key=lambda x: (sum(v > 0 for v in votes[x]), sum(votes[x])))
        sure = min(sure, *votes[best])
    else:
        best = model.members[family][0]
    return ("und" if sure < margin else best), max(sure, 0.0)


def convolution(net, text, width, stride, chunk):
    """Probability of a text: every window of every chunk by itself."""
    import numpy as np

    data = list((text or "").encode())
    if not data:
        return 0.0
    half = chunk // 2
    steps = [data[i : i + width] for i in range(0, len(data), stride)]
    z = [np.maximum(net.embed[w + [256] * (width - len(w))].reshape(-1).astype(np.float64) @ net.conv + net.bias, 0) for w in steps]
    per = half // stride
    halves = [np.max(z[i : i + per], 0) for i in range(0, len(z), per)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    pooled = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])
    return 1 / (1 + math.exp(-(float(pooled @ net.out) + float(net.base[0]))))
