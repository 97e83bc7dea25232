"""The page parser against a plain one by regular expressions, and on long broken pages."""

import random
import re
import time

import pytest

from loomspan.llm import extract

DATA = "/root/testdata/sf0.001"
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
CHROME = re.compile(r"(?i)(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(ads?|advert\w*|nav\w*|menu|foot\w*|side\w*|banner|cookie\w*|share|social|comment\w*|promo)\b")


def brute(page):
    """(parent, name, text, chrome) of each node, with a search for each tag and for each open element."""
    nodes, stack, at = [(-1, "html", "", False)], [(0, "html")], 0
    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not text.isspace():
            nodes.append((stack[-1][0], "#text", text, False))
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == name), None)
            stack = stack[:k] if k else stack
            continue
        if name in extract._RAW:
            end = re.search(rf"</{name}\s*>", page[at:], re.I)
            at = at + end.end() if end else len(page)
            continue
        if name == "html":
            continue
        ended = extract._CLOSES.get(name) or ({"p"} if name in extract._BLOCK else set())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][1] in ended:
                stack = stack[:k]
                break
            if stack[k][1] in extract._SCOPE:
                break
        nodes.append((stack[-1][0], name, "", bool(CHROME.search(m[3]))))
        if name not in extract._VOID and not m[3].endswith("/"):
            stack.append((len(nodes) - 1, name))
    return nodes


def same(page):
    t, want = extract.Tree(page), brute(page)
    code = lambda name: extract._CODE["div"] if name in extract.LABELS else extract._CODE.get(name, len(extract.TAGS) - 1)
    assert list(zip(t.parent, t.tag, t.text, t.chrome)) == [(p, code(n), x, c) for p, n, x, c in want], page


def test_real_pages(spark):
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        same(r.html or "")


def test_random_markup():
    rng = random.Random(1)
    parts = ["<", ">", "</", "<p>", "<P class=nav>", "<div id='side'>", "</div>", "</p>", "<b>", "</b>", "<a ", '"', "'", "<!", "<!--", "-->", "<?x", "text", " ", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "<br/>", "<img src=x>", "<script>", "</script >", "=", "/", "<style", "role=menu", "&amp;", "<article>", "<option>", "<html>", "\n"]
    for _ in range(20_000):
        same("".join(rng.choices(parts, k=rng.randrange(1, 14))))


@pytest.mark.parametrize("unit", ["<a ", "<!", "<a '", '<a "', "<!--", "<", "</", "<p>x", "<b>", "<b><p>", "</i>", "<script>", "<a class=x ", "<div></b>", "class=x id=y role=z "])
def test_long_pages_cost_in_proportion(unit):
    took = []
    for n in (250_000, 1_000_000):
        page = "<p>" + "<a " * (unit[:2] == "cl") + unit * (n // len(unit))
        page += ">" * (unit[:2] == "cl")
        began = time.time()
        extract.Tree(page)
        took.append(time.time() - began)
    assert took[1] < 15 and took[1] < 10 * took[0] + 0.5
    same("<p>" + unit * 50)
