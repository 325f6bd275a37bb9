"""Plain Python definitions the Spark results are compared with."""

import math
import re
import string
from collections import Counter


def tokens_13a(line):
    line = line.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(entity, char)
    line = f" {line} "
    for pattern, repl in (
        (r"([{-~\[-` -&(-+:-@/])", r" \1 "),
        (r"([^0-9])([.,])", r"\1 \2 "),
        (r"([.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        line = re.sub(pattern, repl, line)
    return line.split()


def peeled(line):
    out = []
    for word in line.split():
        if len(word) > 1 and word[-1] in string.punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in string.punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def stats(hyp, ref, orders):
    """h, r, m per order for two sequences."""
    rows = []
    for n in range(1, orders + 1):
        grams = [Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (hyp, ref)]
        rows.append((grams[0].total(), grams[1].total(), (grams[0] & grams[1]).total()))
    return rows


def bleu(hyp, ref, effective=True):
    return bleu_of(stats(tokens_13a(hyp), tokens_13a(ref), 4), effective)


def bleu_of(rows, effective):
    if not any(m for _, _, m in rows):
        return 0.0
    logs, k = [], 1
    for h, _, m in rows:
        if h == 0:
            break
        if m == 0:
            k *= 2
        logs.append(math.log(100 * m / h if m else 100 / (k * h)))
    if not effective and len(logs) < 4:
        return 0.0
    h, r, _ = rows[0]
    penalty = 1.0 if h >= r else math.exp(1 - r / h)
    return penalty * math.exp(sum(logs) / len(logs))


def chrf(hyp, ref, words=0):
    rows = stats("".join(hyp.split()), "".join(ref.split()), 6)
    return chrf_of(rows + stats(peeled(hyp), peeled(ref), words))


def chrf_of(rows):
    used = [(m / h, m / r) for h, r, m in rows if h and r]
    if not used:
        return 0.0
    p, q = (sum(x) / len(used) for x in zip(*used))
    return 100 * 5 * p * q / (4 * p + q) if p + q else 0.0
