"""A corpus of own files in the manner of campaigns, of clean projects and of edge cases, with the rates that are asked of the engine."""

import pytest
from pyspark.sql import functions as F

from threatlake.engine import ThreatEngine
from threatlake.functions.stego import encode_text
from threatlake.operators.corpus import detection_rate
from threatlake.operators.findings import severity_ratio

BLOB = "Zm9vYmFyYmF6cXV4MDEyMzQ1Njc4OUFCQ0RFRkdISUpLTE1OT1BRUlNUVVZXWFlaYWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo="
CAMPAIGN = {
    "hidden_payload.js": f"const s = `{encode_text(b'fetch(host + path).then(run)')}`;\nrun(decode(s));",
    "pipe.js": f"module.exports = 'name|{encode_text(b'secret')}|end';",
    "decoder.ts": "export const d = (s: string) => [...s].map(c => c.codePointAt(0)! - 0xFE00).filter(c => c !== null);\neval(String.fromCharCode(...d(x)))",
    "loader.js": f'const blob = "{BLOB}"\nconst f = new Function(atob(blob))\nf()',
    "channel.js": 'https.get(u, res => {\n  const k = res.headers["x-k"]\n  const d = crypto.createDecipheriv("aes-256-cbc", k, iv)\n  eval(d.update(b, "hex", "utf8"))\n})',
    "xor_channel.js": 'const r = await fetch(u)\nconst h = r.headers.get("x")\nlet o = h.charCodeAt(0) ^ 7\nt += String.fromCharCode(o)\nnew Function(t)()',
    "key.js": 'const k = "0123456789abcdef0123456789abcdef"\nconst d = crypto.createDecipheriv("alg", k, iv)\nlet p = d.update(blob, "hex", "utf8")\neval(p)',
    "direction.js": "const access = 'user‮ ⁦// admin⁩ ⁦';",
    "lookalike.js": "const pаypal = connect();\nif (сount > 1) pаypal.send()",
    "zero_width.mjs": "import run from 'ru​n'\nrun()",
    "plain_text.js": "// nothing that a rule knows: a moved address\nconst host = parts.reverse().join('.')\nconnect(host)",
}
CLEAN = {
    "i18n.js": "export const labels = { ru: 'Привет, мир', el: 'Καλημέρα', ja: 'こんにちは', ar: 'مرحبا' };",
    "emoji.js": "console.log('done ☀️ 😀‍');",
    "pure_cyrillic.js": "let сообщение = 'тест';\nconsole.log(сообщение)",
    "hash.js": "const h = crypto.createHash('sha256').update(data).digest('hex')\nexport default h",
    "minified.js": "!function(e,t){var n=e.document;n.title=t;for(var r=0;r<t.length;r++)n.body.append(t[r])}(window,'a b c');",
    "data.json": '{"logo": "data:image/png;base64,iVBORw0KGgo", "n": 1}',
    "regex.ts": "export const clean = (s: string): string => s.replace(/[^a-z0-9]/g, '-')\nif (ok) /a[/]b/.test(s)",
    "fetch.js": "const r = await fetch('/api/items')\nconst items = await r.json()\nrender(items)",
    "class.ts": "class Box<T> {\n  private items: T[] = []\n  add(x: T) { this.items.push(x) }\n}",
    "style.py": "def area(r):\n    return 3.14159 * r ** 2\n",
}
EDGE = {
    "crlf.js": ("const a = 1;\r\nconst b​ = 2;\r\n", ["invisible_character"]),
    "comment.js": ("// pаypal\nconst a = 1;", []),
    "only_eval.js": ("eval(x)", []),
    "two_indicators.js": ("eval(atob(x))", ["glassware_pattern"] * 2),
    "open_string.js": ("const a = 'never closed\neval(x)", []),
    "empty.js": ("", []),
}


@pytest.fixture(scope="module")
def found(spark):
    every = [*((f"campaign/{n}", c) for n, c in CAMPAIGN.items()), *((f"clean/{n}", c) for n, c in CLEAN.items()), *((f"edge/{n}", c) for n, (c, _) in EDGE.items())]
    files = spark.createDataFrame(every, "path string, content string").withColumn("set", F.split("path", "/")[0])
    rows = ThreatEngine.default().scan(files.select("path", "content")).withColumn("set", F.split("path", "/")[0]).cache()
    return files, rows


def test_rates(found):
    files, rows = found
    rollup = files.join(rows.groupBy("path").agg(F.count(F.lit(1)).alias("finding_count")), "path", "left").fillna(0)
    rates = {r["set"]: r.rate for r in detection_rate(rollup, ("set",)).collect()}
    assert rates["campaign"] >= 70 and rates["clean"] == 0
    assert {r["set"]: r.ratio for r in severity_ratio(rows, ("set",)).collect()}["campaign"] >= 50


def test_what_each_campaign_file_shows(found):
    shown = {}
    for r in found[1].where("set = 'campaign'").collect():
        shown.setdefault(r.path.split("/")[1], set()).add(r.category)
    want = {
        "hidden_payload.js": "stegano_payload", "pipe.js": "pipe_delimiter_stego", "decoder.ts": "decoder_function", "loader.js": "encrypted_payload", "channel.js": "header_c2", "xor_channel.js": "header_c2",
        "key.js": "hardcoded_key_decryption", "direction.js": "bidirectional_override", "lookalike.js": "homoglyph", "zero_width.mjs": "invisible_character",
    }
    assert all(category in shown[name] for name, category in want.items()) and "plain_text.js" not in shown


def test_edge_cases(found):
    shown = {}
    for r in found[1].where("set = 'edge'").collect():
        shown.setdefault(r.path.split("/")[1], []).append(r.category)
