"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance from the nearest ancestor directory.

A passage is a line, a paragraph of several, or a whole file, with a word that every license statement has (an anchor). Its terms and those of the templates are weighted by counts times inverse frequency
among the templates, so what else is in a corpus changes nothing, and compared through the terms they share. Licenses of a family differ in a few terms, so a template also says which terms a passage must have (a version, `affero`,
`noncommercial`) and which it must not. A file's own license is its best passage's. Files that are mostly license text, or are named like one, license their directory; a file without a license of its
own takes that of the nearest directory above it.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.shared import cut, table

# ---- Fixed values: names of licenses and the words of their texts.
#: (identifier without version, name, versions, terms that tell it from others); the forms of a statement are made from these by rule.
NAMES = [
    ("AFL", "Academic Free License", ["3.0"], ["academic"]), ("AGPL", "GNU Affero General Public License", ["1.0", "3.0"], ["affero"]), ("Apache", "Apache License", ["1.0", "1.1", "2.0"], ["apache"]),
    ("Artistic", "Artistic License", ["1.0", "2.0"], ["artistic"]), ("BSL", "Boost Software License", ["1.0"], ["boost"]), ("CDDL", "Common Development and Distribution License", ["1.0", "1.1"], ["common", "development"]),
    ("CECILL", "CeCILL Free Software License Agreement", ["2.0", "2.1"], ["cecill"]), ("CPL", "Common Public License", ["1.0"], ["common", "public"]), ("ECL", "Educational Community License", ["1.0", "2.0"], ["educational"]),
    ("EPL", "Eclipse Public License", ["1.0", "2.0"], ["eclipse"]), ("EUPL", "European Union Public License", ["1.1", "1.2"], ["european"]), ("GFDL", "GNU Free Documentation License", ["1.1", "1.2", "1.3"], ["documentation"]),
    ("GPL", "GNU General Public License", ["1.0", "2.0", "3.0"], ["general", "public"]), ("LGPL", "GNU Lesser General Public License", ["2.1", "3.0"], ["lesser"]), ("LGPL", "GNU Library General Public License", ["2.0"], ["library", "general"]),
    ("LPPL", "LaTeX Project Public License", ["1.2", "1.3"], ["latex"]), ("MPL", "Mozilla Public License", ["1.0", "1.1", "2.0"], ["mozilla"]), ("ODbL", "Open Database License", ["1.0"], ["database"]), ("OFL", "SIL Open Font License", ["1.0", "1.1"], ["font"]),
    ("OSL", "Open Software License", ["2.1", "3.0"], ["open", "software"]), ("UPL", "Universal Permissive License", ["1.0"], ["universal"]), ("Zlib", "zlib License", [""], ["zlib"]), ("ISC", "ISC License", [""], ["isc"]), ("MIT", "MIT License", [""], ["mit"]),
    ("BSD-2-Clause", "BSD 2-Clause License", [""], ["bsd", "2", "clause"]), ("BSD-3-Clause", "BSD 3-Clause License", [""], ["bsd", "3", "clause"]), ("BSD-4-Clause", "BSD 4-Clause License", [""], ["bsd", "4", "clause"]), ("WTFPL", "WTFPL", [""], ["wtfpl"]),
    ("NCSA", "University of Illinois/NCSA Open Source License", [""], ["ncsa"]), ("PostgreSQL", "PostgreSQL License", [""], ["postgresql"]), ("MS-PL", "Microsoft Public License", [""], ["microsoft"]), ("Python", "Python Software Foundation License", ["2.0"], ["python"]),
]
#: Terms that set a license of the same name apart: a statement with one of them isn't of the plain name.
APART = {"GPL": ["affero", "lesser", "library", "documentation", "linking"], "CPL": ["development", "creative"], "OSL": ["academic"]}
SHORT = {"AGPL": "agpl", "GPL": "gpl", "LGPL": "lgpl", "MPL": "mpl", "EPL": "epl"}
#: Elements of Creative Commons licenses: code and name.
ELEMENTS = {"NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
KINDS = [(), ("NC",), ("NC", "ND"), ("NC", "SA"), ("ND",), ("SA",)]
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ADVERTISING = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
PERMIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
NOTICE = "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
KEEP = "provided that the above copyright notice and this permission notice appear in all copies."
AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: (license, text, terms it must have, terms it must not have): whole texts of short licenses, and headers that no rule makes.
TEXTS = [
    ("MIT", f"{PERMIT}, {NOTICE} {AS_IS}", ["sublicense", "portions"], []), ("MIT", f"{PERMIT}, {NOTICE}", ["sublicense", "portions"], []), ("MIT", PERMIT.split(", including")[0], ["deal", "restriction"], []), ("MIT-0", f"{PERMIT}. {AS_IS}", ["sublicense"], ["portions"]),
    ("ISC", f"{USE}, {KEEP} {AUTHOR}", ["appear"], []), ("ISC", f"{USE}, {KEEP}", ["appear"], []), ("0BSD", f"{USE}. {AUTHOR}", ["fee"], ["appear"]),
    ("BSD-2-Clause", f"{BSD} {DISCLAIMER}", ["redistributions"], ["endorse", "advertising"]), ("BSD-3-Clause", f"{BSD} {ENDORSE} {DISCLAIMER}", ["redistributions", "endorse"], ["advertising"]), ("BSD-4-Clause", f"{BSD} {ADVERTISING} {ENDORSE} {DISCLAIMER}", ["redistributions", "advertising"], []),
    ("BSD-2-Clause", BSD, ["redistributions"], ["endorse", "advertising"]), ("BSD-3-Clause", f"{BSD} {ENDORSE}", ["redistributions", "endorse"], ["advertising"]), ("BSD-3-Clause", f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {ENDORSE}", ["endorse"], ["advertising"]),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such. This notice may not be removed or altered from any source distribution.", ["misrepresented"], []),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ["unencumbered"], []), ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["unencumbered"], []),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived"], []), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Licensed under CC0 1.0.", ["waived"], []), ("CC0-1.0", "Licensed under CC0 1.0.", ["cc0"], []), ("CC0-1.0", "This work is licensed under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", ["cc0"], []),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', ["apache", "version2"], []),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ["apache", "version2"], []),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla", "version2"], []), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["mozilla", "version2"], []),
    ("All-Rights-Reserved", "All rights reserved.", ["rights", "reserved"], ["redistribution", "redistributions", "permission", "licensed", "license", "licence", "waived"]), ("All-Rights-Reserved", "Copyright. All rights reserved.", ["rights", "reserved"], ["redistribution", "redistributions", "permission", "licensed", "license", "licence", "waived"]),
]
FORMS = ["Licensed under the {}.", "This work is licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "{}"]
GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GNU_END = "This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."


def by_rule() -> list[tuple[str, str, list[str], list[str]]]:
    """(license, text, terms it must have, terms it must not have) of every template."""
    out = list(TEXTS)
    plain = lambda v: v.removesuffix(".0")
    for code, name, versions, terms in NAMES:
        for v in versions:
            license, need, apart = code + (f"-{v}" if v else ""), terms + ([f"version{plain(v)}"] if v else []), APART.get(code, [])
            for form in FORMS:
                out += [(license, form.format(f"{name}, version {v}" if v else name), need, apart)]
                out += [(license, form.format(f"{name} {v}"), need, apart)] if v else []
            if code in SHORT:
                out += [(license, form.format(f"{SHORT[code]} version {v}"), [SHORT[code], f"version{plain(v)}"], []) for form in FORMS]
            if "General Public" in name:
                what = "library" if code == "LGPL" else "program"
                out += [(license, GNU.format(what, name, plain(v)), need, [x for x in apart if x != "library"]), (license, GNU.format(what, name, plain(v)) + " " + GNU_END.format(what, name), need, [x for x in apart if x != "library"])]
    for kind, v in product(KINDS, ["1.0", "2.0", "2.5", "3.0", "4.0"]):
        license = "-".join(["CC-BY", *kind, v])
        others = [w for k, n in ELEMENTS.items() if k not in kind for w in (k.lower(), n.lower(), *(["noderivs"] if k == "ND" else []))]
        code, name = "-".join(["CC BY", *kind]), "-".join(["Attribution", *[ELEMENTS[k] for k in kind]])
        out += [(license, form.format(f"{code} {v}"), ["cc", "by", *[k.lower() for k in kind], f"version{plain(v)}"], others) for form in FORMS]
        for tail in ("International License", "Unported License", "License"):
            out += [(license, f"This work is licensed under a Creative Commons {name} {v} {tail}.", ["creative", "attribution", *[ELEMENTS[k].lower() for k in kind], f"version{plain(v)}"], others)]
    return out


TEMPLATES = by_rule()
ANCHOR = r"(?i)licen[sc]e|copyright|rights|permission|redistribut|public domain|terms of|as.is|free and unencumbered|wtfpl|\bcc|gpl|\bmpl|\bepl"
#: What is done to lower-case text, in turn, before its terms are taken: numbers without `.0`, and versions joined to the word.
NORMAL = [(r"([0-9])\.0+\b", r"\1"), (r"\b(?:version|ver|v)[. ]*([0-9])", r"version\1"), (r"(gpl|mpl|epl|licen[sc]e|agreement|[^a-z]by|[^a-z]sa|[^a-z]nc|[^a-z]nd|attribution|sharealike|noncommercial|noderivatives|noderivs|cc0)[ ,-]+([0-9])", r"\1 version\2")]
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
NAMED = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"
LEAST, MOSTLY = 0.6, 0.5


def terms_of(text):
    """The normalised terms of a text column."""
    x = F.lower(text)
    for old, new in NORMAL:
        x = F.regexp_replace(x, old, new.replace("\\", "$"))
    return F.regexp_extract_all(x, F.lit(TERM), 0)


def directory(path):
    """The part of a path before its last slash, empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, templates: list | None = None, least: float = LEAST, mostly: float = MOSTLY, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(doc_id, path, license, score, basis, origin) for every row: basis is `own` or `inherited`, origin the path of the file that says so; all four null if there is no license.

    A passage's license is that of the template of highest cosine among those whose terms it has and whose other terms it hasn't, if the cosine is `least` or more; equal ones are decided by the name. A license of the whole file comes before those of its passages. A file licenses its directory if
    lines with a license make up the share `mostly` of its characters, if it has a license as a whole, or if it is named like a license; of several, the highest score and then the least path decide. Null and empty texts have no license of their own but inherit.
    A null path counts as empty, which is the top directory's. Rows that repeat an id and a path share the best license found in any. An empty table gives an empty result. Other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    rows = files.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    named = rows.select("doc_id", "path").distinct()
    paragraphs = F.filter(F.split("t", r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    parts = F.array_distinct(F.concat(F.split("t", "\n"), paragraphs, F.array("t")))
    found = rows.where(F.col("t").rlike(ANCHOR)).select("doc_id", "path", F.greatest(F.length("t"), F.lit(1)).alias("size"), F.explode(parts).alias("part")).where(F.col("part").rlike(ANCHOR))
    # From here on a passage is its digest: texts aren't shuffled again.
    shape = [F.md5(F.col("part").cast("binary")).alias("part"), F.col("part").contains("\n").alias("multi"), F.length("part").alias("length"), terms_of(F.col("part")).alias("terms")]
    found = found.select("doc_id", "path", "size", *shape).where("size(terms) > 0")
    found = cut(found.dropDuplicates(["doc_id", "path", "size", "part"]), "parts")

    spark = files.sparkSession
    # `known`: a row for each template and term of it, or that it must not have (bad). Of the templates alone, so it is small.
    known = spark.createDataFrame([(k, n, x, need, bad) for k, (n, x, need, bad) in enumerate(templates)], "tpl int, license string, x string, need array<string>, bad array<string>")
    own_terms = known.select("tpl", "license", "need", F.explode(terms_of(F.col("x"))).alias("term")).groupBy("tpl", "license", "need", "term").agg(F.count("*").alias("tf"))
    idf = own_terms.groupBy("term").agg((F.log((F.lit(1.0) + len(templates)) / (F.lit(1.0) + F.count("*"))) + 1).alias("idf"))
    foreign = F.log(F.lit(1.0 + len(templates))) + 1  # of a term that no template has
    weighted = own_terms.join(idf, "term").withColumn("w2", F.col("tf") * F.col("idf"))
    weighted = weighted.select("tpl", "license", "term", "w2", F.sqrt(F.sum(F.col("w2") * F.col("w2")).over(Window.partitionBy("tpl"))).alias("norm2"), F.size("need").alias("needs"), F.array_contains("need", F.col("term")).cast("int").alias("has"), F.lit(0).alias("bad"))
    against = known.select("tpl", "license", F.explode("bad").alias("term")).join(weighted.groupBy("tpl").agg(F.max("norm2").alias("norm2"), F.max("needs").alias("needs")), "tpl")
    known = cut(weighted.unionByName(against.select("tpl", "license", "term", F.lit(0.0).alias("w2"), "norm2", "needs", F.lit(0).alias("has"), F.lit(1).alias("bad"))), "known")
    idf = cut(idf, "idf")
    # Equal passages, of which there may be many, are scored once.
    texts = found.groupBy("part").agg(F.first("terms").alias("terms"))
    tf = cut(texts.select("part", F.explode("terms").alias("term")).groupBy("part", "term").agg(F.count("*").alias("tf")), "tf")
    # A template can only be that of passages with all the terms it asks for, so a passage meets those whose rarest such term it has.
    rare = known.where("has = 1").join(idf, "term").groupBy("tpl").agg(F.max_by("term", F.struct("idf", "term")).alias("term"))
    keys = rare.select("term", "tpl").unionByName(known.where("needs = 0 and bad = 0").select("term", "tpl"))  # one that asks for none is met by any of its terms
    meets = cut(tf.join(F.broadcast(keys), "term").select("part", "tpl").distinct(), "meets")
    weights = tf.join(meets.select("part").distinct(), "part").join(F.broadcast(idf), "term", "left").select("part", "term", (F.col("tf") * F.coalesce("idf", foreign)).alias("w"))
    norms = weights.groupBy("part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weights.join(meets, "part").join(F.broadcast(known), ["tpl", "term"]).groupBy("part", "tpl", "license", "norm2", "needs").agg(F.sum(F.col("w") * F.col("w2")).alias("dot"), F.sum("has").alias("has"), F.max("bad").alias("bad"))
    scored = dots.where("has = needs and bad = 0").join(norms, "part").select("part", "license", F.round(F.col("dot") / (F.col("norm") * F.col("norm2")), 6).alias("score"))
    best = scored.where(F.col("score") >= least).groupBy("part").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    best = cut(best.select("part", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "best")
    licensed = found.drop("terms").join(best, "part")
    own = licensed.groupBy("doc_id", "path").agg(F.min(F.struct((F.col("length") < F.col("size")).alias("inside"), (-F.col("score")).alias("s"), "license")).alias("b"), F.sum(F.when(F.col("length") == F.col("size"), 1).when(F.col("multi"), 0).otherwise(F.col("length") / F.col("size"))).alias("share"))
    own = cut(own.select("doc_id", "path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "share"), "own")

    by_dir = own.where((F.col("share") >= mostly) | name.rlike(NAMED)).groupBy(directory(F.col("path")).alias("up")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b"))
    dirs = named.select(directory(F.col("path")).alias("dir")).distinct()
    # a directory and all above it: its first n names for each n, and the top one
    pieces = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(pieces))), lambda n: F.struct(F.array_join(F.slice(pieces, F.lit(1), n), "/").alias("up"), n.alias("depth")))
    near = dirs.select("dir", F.explode(above).alias("a")).select("dir", "a.up", "a.depth").join(by_dir, "up").groupBy("dir").agg(F.max_by("b", "depth").alias("b"))
    near = near.select("dir", F.col("b.license").alias("license2"), (-F.col("b.s")).alias("score2"), F.col("b.path").alias("origin2"))
    full = rows.select("doc_id", "path").withColumn("dir", directory(F.col("path")))
    mine = own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "license", "score")
    full = full.join(mine, full["doc_id"].eqNullSafe(mine["_id"]) & (full["path"] == mine["_path"]), "left").join(near, "dir", "left")
    has = F.col("license").isNotNull()
    basis = F.when(has, F.lit("own")).when(F.col("license2").isNotNull(), F.lit("inherited"))
    return full.select("doc_id", "path", F.coalesce("license", "license2").alias("license"), F.when(has, F.col("score")).otherwise(F.col("score2")).alias("score"), basis.alias("basis"), F.when(has, F.col("path")).otherwise(F.col("origin2")).alias("origin"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents, as files source/thousand/id.txt."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.expr("cast(doc_id div 1000 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


_Q = lambda s: "'" + s.replace("'", "''") + "'"


def _terms(x: str) -> str:
    x = f"lower({x})"
    for old, new in NORMAL:
        x = f"regexp_replace({x}, {_Q(old)}, {_Q(new)}, 'g')"
    return f"regexp_extract_all({x}, {_Q(TERM)})"


_L = lambda words: "[" + ", ".join(map(_Q, words)) + "]::varchar[]"
ORACLE_OP1 = f"""
with files as (
  select doc_id, concat_ws('/', source, (doc_id // 1000)::varchar, doc_id::varchar || '.txt') as path, coalesce(text, '') as t from documents),
parts as (
  select distinct doc_id, path, greatest(length(t), 1) as size,
    unnest(list_distinct(string_split(t, chr(10)) || list_filter(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10))) || [t])) as part
  from files where regexp_matches(t, {_Q(ANCHOR)})),
found as (select * from (select *, {_terms('part')} as terms from parts where regexp_matches(part, {_Q(ANCHOR)})) where len(terms) > 0),
templates as (select * from (values {', '.join(f"({k}, {_Q(n)}, {_Q(x)}, {_L(need)}, {_L(bad)})" for k, (n, x, need, bad) in enumerate(TEMPLATES))}) as v(tpl, license, x, need, bad)),
own_terms as (select tpl, license, need, term, count(*) as tf from (select tpl, license, need, unnest({_terms('x')}) as term from templates) group by 1, 2, 3, 4),
idf as (select term, ln({len(TEMPLATES) + 1}::double / (1 + count(*))::double) + 1 as idf from own_terms group by 1),
weighted0 as (select tpl, license, term, need, tf * idf as w2 from own_terms join idf using (term)),
weighted as (select *, sqrt(sum(w2 * w2) over (partition by tpl)) as norm2 from weighted0),
texts as (select distinct part, terms from found),
tf as (select part, term, count(*) as tf from (select part, unnest(terms) as term from texts) group by 1, 2),
weights as (select part, term, tf * coalesce(idf, ln({len(TEMPLATES) + 1}::double) + 1) as w from tf left join idf using (term)),
norms as (select part, sqrt(sum(w * w)) as norm from weights group by 1),
dots as (select part, tpl, license, norm2, sum(w * w2) as dot from weights join weighted using (term) group by 1, 2, 3, 4),
fitting as (select d.* from dots d join texts using (part) join templates t using (tpl) where list_has_all(texts.terms, t.need) and not list_has_any(texts.terms, t.bad)),
scored as (select part, license, round(dot / (norm * norm2), 6) as score from fitting join norms using (part)),
best as (select part, license, score from (select *, row_number() over (partition by part order by score desc, license) as r from scored where score >= {LEAST}) where r = 1),
licensed as (select f.doc_id, f.path, f.size, f.part, b.license, b.score from found f join best b using (part)),
own as (
  select doc_id, path, first(license order by length(part) < size, score desc, license) as license, first(score order by length(part) < size, score desc, license) as score,
    sum(case when length(part) = size then 1 when contains(part, chr(10)) then 0 else length(part) / size::double end) as share
  from licensed group by 1, 2),
by_dir as (  select regexp_extract(path, '^(.*)/[^/]*$', 1) as up, first(license order by score desc, path) as license, max(score) as score, first(path order by score desc, path) as origin
  from own where share >= {MOSTLY} or regexp_matches(regexp_extract(path, '([^/]*)$', 1), {_Q(NAMED)}) group by 1),
dirs as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from files),
above as (select dir, unnest(range(0, case when dir = '' then 1 else len(string_split(dir, '/')) + 1 end)) as depth from dirs),
near as (
  select dir, first(license order by depth desc) as license2, first(score order by depth desc) as score2, first(origin order by depth desc) as origin2
  from above join by_dir on array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') = up group by 1)
select f.doc_id, f.path, coalesce(o.license, n.license2) as license, case when o.license is not null then o.score else n.score2 end as score,
  case when o.license is not null then 'own' when n.license2 is not null then 'inherited' end as basis, case when o.license is not null then f.path else n.origin2 end as origin
from files f left join own o on o.doc_id is not distinct from f.doc_id and o.path = f.path
left join near n on n.dir = regexp_extract(f.path, '^(.*)/[^/]*$', 1)
"""
