"""Plain-Python readings of some headline queries: one process, rows as tuples, no engine.

The engine's figures need something to stand beside, and no other figures exist. Every function reads the same Parquet
tables as the query of its name and computes the same rows with loops, dictionaries and regular expressions.
Prints one JSON line like bench.py.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections import Counter, defaultdict

import pyarrow.parquet as pq

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WORD = re.compile(r"\w+")
NUMBER = re.compile(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?")


def rows(table: str, *columns: str):
    found = pq.read_table(f"{SF_DIR}/{table}.parquet", columns=list(columns))
    return zip(*(found.column(c).to_pylist() for c in columns), strict=True)


def tier(reported: float, computed: float) -> str:
    far = abs(reported - computed)
    share = far / max(abs(computed), 1e-9) * 100
    return "deterministic" if far >= 2 or share >= 5 else "likely_error" if far >= 0.5 or share >= 1 else "ambiguous"


def q01_table_mean_audit():
    orders = defaultdict(list)
    for key, *line in rows("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"):
        orders[key].append(tuple(line))
    out = []
    for key, lines in orders.items():
        if len(lines) >= 3:
            *parts, last = [line[-1] for line in sorted(lines)]
            mean = sum(parts) / len(parts)
            if abs(last - mean) > 0.005:
                out.append((key, len(parts), f"{last:.2f}", f"{mean:.2f}", f"{last - mean:+.2f}", tier(last, mean)))
    return out


def q03_grouped_mean_of_means():
    groups = defaultdict(lambda: defaultdict(list))
    for key, flag, quantity in rows("lineitem", "l_orderkey", "l_returnflag", "l_quantity"):
        groups[key][flag].append(quantity)
    return [(k, len(g), sum(sum(v) / len(v) for v in g.values()) / len(g), sum(map(sum, g.values())) / sum(map(len, g.values()))) for k, g in groups.items() if len(g) > 1]


def q06_unique_key():
    seen = Counter(rows("lineitem", "l_orderkey", "l_linenumber"))
    return [(*k, n - 1) for k, n in seen.items() if n > 1]


def q12_declared_vs_actual():
    sums = defaultdict(int)
    for key, price in rows("lineitem", "l_orderkey", "l_extendedprice"):
        sums[key] += round(price * 100)
    return [(k, total, sums[k]) for k, total in rows("orders", "o_orderkey", "o_totalprice") if k in sums and round(total * 100) != sums[k]]


def q17_word_cite_stats():
    mark = re.compile(r"\[\d+(?:,\s*\d+)*(?:-\d+)?\]|\([A-Z][A-Za-z-]+(?: et al\.)?,\s*\d{4}\)")
    return [(key, len(WORD.findall(text or "")), len(mark.findall(text or ""))) for key, text in rows("documents", "doc_id", "text")]


def q18_section_segments():
    out = []
    for key, text in rows("documents", "doc_id", "text"):
        title, words, no = None, 0, 0
        for line in (text or "").split("\n"):
            n = len(WORD.findall(line))
            if 1 <= n <= 3:
                out.append((key, no, title, words))
                title, words, no = line, 0, no + 1
            else:
                words += n
        out.append((key, no, title, words))
    return [r for r in out if r[3]]


def q22_number_extract():
    out = []
    for key, text in rows("documents", "doc_id", "text"):
        for no, line in enumerate((text or "").split("\n"), 1):
            if found := NUMBER.findall(line):
                out.append((key, no, len(found), found[0], line[: line.find(found[0])].strip()))
    return out


def q25_unknown_tokens():
    known = {w for (text,) in rows("benchmark", "text") for w in WORD.findall(text or "")}
    return [(key, len(set(WORD.findall(text or "")) - known)) for key, text in rows("documents", "doc_id", "text")]


def q38_html_structure():
    from html.parser import HTMLParser

    class Counts(HTMLParser):
        def __init__(self):
            super().__init__()
            self.seen = Counter()

        def handle_starttag(self, tag, attrs):
            self.seen["<" + tag] += 1

        def handle_endtag(self, tag):
            self.seen[">" + tag] += 1

    out = []
    for key, html in rows("pages", "page_id", "html"):
        parser = Counts()
        parser.feed(html or "")
        out.append((key, parser.seen[">table"], parser.seen["<section"], parser.seen["<p"] != parser.seen[">p"]))
    return out


def op8_exact_dedup():
    import hashlib

    texts = list(rows("documents", "doc_id", "text"))
    best, size = {}, Counter()
    for key, text in texts:
        best[text or ""] = max(key, best.get(text or "", key))
        size[text or ""] += 1
    return [(k, best[t or ""], size[t or ""], k == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for k, t in texts]


READINGS = (q01_table_mean_audit, q03_grouped_mean_of_means, q06_unique_key, q12_declared_vs_actual, q17_word_cite_stats, q18_section_segments, q22_number_extract, q25_unknown_tokens, q38_html_structure, op8_exact_dedup)


def main() -> None:
    seconds = {}
    for reading in READINGS:
        start = time.perf_counter()
        reading()
        seconds[reading.__name__] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "plain_python_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
