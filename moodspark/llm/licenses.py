"""Licence scans with a positional rare-token index, in SQL functions only.

A template is a licence statement or a whole licence text, a label and the
mandatory phrase inside it; all its words are posted with their positions. The
corpus is split into words once: of each text, the template words that it holds
are kept, and its words only if it holds all words of some mandatory phrase.
From the former come the inverse document frequencies. The scan looks up, for
each phrase that a text may hold, its two words of highest IDF, turns their
places into places of the template and intersects these by relative position;
what is left is verified against the whole phrase and weighed by the IDF of all
template words found at their places. Everything is a projection of one row: no
join, no Python; a text with a thousand hits stays one row.

Words are runs of characters that are none of ASCII 0x00-0x2F, 0x3A-0x60 and
0x7B-0x7F after A-Z are lower-cased. The score of a text is the largest share
of a template's weight found around a whole mandatory phrase, else 0.

Cases: null and empty texts have no words, no labels and score 0; of words of
equal IDF the first in the phrase is looked up; very long texts are one row like
any other; repeated rows give repeated results; an empty table gives no rows and
needs no counts; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import ascii_lower, narrow, text_or_empty
from moodspark.session import materialize

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values: (label, base, statement, mandatory phrase).
TEMPLATES = (
    ("gpl", True, "licensed under the gnu general public license version 3", "gnu general public license"),
    ("apache", True, "licensed under the apache license version 2 0", "apache license"),
    ("cc-by", True, "licensed under cc by 4 0", "cc by"),
    ("mit", True, "released under the mit license", "mit license"),
    ("agpl", False, "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("lgpl", False, "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("cc-by-nc", False, "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", False, "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", False, "released under cc0 1 0 universal", "cc0 1 0"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("mpl", False, "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", False, "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("unlicense", False, "free and unencumbered software released into the public domain", "free and unencumbered software"),
    # whole texts and notices, without punctuation
    ("mit", False, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
     "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
     "sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following "
     "conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the "
     "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
     "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
     "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
     "dealings in the software", "permission is hereby granted free of charge"),
    ("bsd", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
     "are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 "
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
     "documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is "
     "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
     "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or "
     "consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
     "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
     "arising in any way out of the use of this software even if advised of the possibility of such damage",
     "redistribution and use in source and binary forms"),
    ("isc", False, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
     "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties "
     "with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any "
     "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of "
     "contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
     "permission to use copy modify and or distribute this software"),
    ("zlib", False, "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
     "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications "
     "and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you "
     "must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would "
     "be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the "
     "original software 3 this notice may not be removed or altered from any source distribution",
     "the origin of this software must not be misrepresented"),
    ("apache", False, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
     "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
     "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
     "license for the specific language governing permissions and limitations under the license",
     "you may not use this file except in compliance with the license"),
    ("gpl", False, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
     "by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope "
     "that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see "
     "the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
     "under the terms of the gnu general public license"),
    ("lgpl", False, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version this library is distributed in "
     "the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular "
     "purpose", "under the terms of the gnu lesser general public license"),
    ("agpl", False, "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version",
     "under the terms of the gnu affero general public license"),
    ("mpl", False, "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
     "file you can obtain one at https mozilla org mpl 2 0", "subject to the terms of the mozilla public license"),
    ("unlicense", False, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
     "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in "
     "jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to "
     "the public domain", "free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BREAK), "")


def _start(words: list[str], must: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(must)] == must)


def split_once(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, present (the template words that the text holds), words (NULL if no mandatory phrase can be in the text)."""
    vocabulary = sorted({w for _, _, statement, _ in templates for w in statement.split()})
    phrases = sorted({phrase for _, _, _, phrase in templates})
    base = narrow(docs, doc_id=id_col, text=text_col)
    rows = base.select("doc_id", words_of(text_or_empty()).alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.array_intersect("words", _words_of(" ".join(vocabulary))).alias("present"))
    possible = F.exists(F.array(*[_words_of(p) for p in phrases]), lambda p: F.size(F.array_except(p, F.col("present"))) == 0)
    return materialize(rows.select("doc_id", "n_words", "present", F.when(possible, F.col("words")).alias("words")))


def _words_of(text: str) -> Column:
    return F.split(F.lit(text), " ")


def licence_idf(rows: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """ln((rows + 1) / (rows with the word + 1)) of each template word, over all rows of ``split_once``.

    The result has one entry per template word, so its size is that of the templates.
    """
    # the row itself counts under the empty word, so one aggregation has the number of rows too
    counts = rows.select(F.explode(F.concat("present", F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    n = found.get("", 0)
    return {w: math.log((n + 1) / (found.get(w, 0) + 1)) for w in sorted({w for _, _, statement, _ in templates for w in statement.split()})}


def template_index(idf: dict[str, float], templates=TEMPLATES) -> list[dict]:
    """Per template its words with their weights, and the places of the two words of highest IDF in its mandatory phrase."""
    index = []
    for label, base, statement, phrase in templates:
        words, must = statement.split(), phrase.split()
        at = _start(words, must)
        rare, second = sorted(range(len(must)), key=lambda j: (-idf[must[j]], j))[:2]
        weights = [idf[w] for w in words]
        index.append({"label": label, "base": base, "words": words, "weights": weights, "total": sum(weights) or 1.0, "at": at, "must": must,
                      "rare": must[rare], "rare_at": at + rare, "second": must[second], "second_at": at + second})
    return index


def _literal(index: list[dict]) -> str:
    """The index as one array of structs."""
    def one(t: dict) -> str:
        return (f"named_struct('label', '{t['label']}', 'base', {str(t['base']).lower()}, 'words', split('{' '.join(t['words'])}', ' '), "
                f"'weights', array({', '.join(f'{w!r}D' for w in t['weights'])}), 'total', {t['total']!r}D, 'at', {t['at']}, "
                f"'must', split('{' '.join(t['must'])}', ' '), 'r', '{t['rare']}', 'ra', {t['rare_at']}, 's', '{t['second']}', 'sa', {t['second_at']})")
    return "array(" + ", ".join(one(t) for t in index) + ")"


def scan(rows: DataFrame, idf: dict[str, float], templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words and ``found``: array of (label, base, start of the mandatory phrase, share of the weight); NULL without words."""
    may = f"filter({_literal(template_index(idf, templates))}, t -> words is not null and size(array_except(t.must, present)) = 0)"
    posted = rows.select("doc_id", "n_words", "words", F.expr(may).alias("may"))
    hits = """filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)),
                     h -> array_contains(flatten(transform(may, t -> array(t.r, t.s))), h.w))"""
    placed = posted.withColumn("hits", F.expr(hits))
    found = """filter(flatten(transform(may, t -> transform(
        array_intersect(transform(filter(hits, h -> h.w = t.r), h -> h.i - t.ra), transform(filter(hits, h -> h.w = t.s), h -> h.i - t.sa)),
        first -> named_struct('label', t.label, 'base', t.base, 'start', cast(first + t.at as bigint),
            'share', aggregate(transform(t.words, (w, j) -> if(get(words, first + j) = w, get(t.weights, j), 0D)), 0D, (x, y) -> x + y) / t.total,
            'whole', forall(transform(t.must, (w, j) -> coalesce(get(words, first + t.at + j) = w, false)), ok -> ok))))), f -> f.whole)"""
    return placed.select("doc_id", "n_words", F.expr(found).alias("found"))


def licence_report(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of ``docs``."""
    split = split_once(docs, templates)
    rows = scan(split, licence_idf(split, templates), templates)
    base = F.filter("found", lambda x: x["base"])
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.when(F.col("found").isNull(), 0).otherwise(F.size(base)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        F.coalesce(join(base), F.lit("")).alias("base_labels"), F.coalesce(join(F.col("found")), F.lit("")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)), 6).alias("score"))


def licence_sql(templates=TEMPLATES) -> str:
    """The same result without an index: every template word joined by relative position."""
    rows = []
    for k, (label, base, statement, phrase) in enumerate(templates):
        words, must = statement.split(), phrase.split()
        at = _start(words, must)
        rows += [f"({k}, '{label}', {str(base).lower()}, {j}, '{w}', {at}, {len(must)})" for j, w in enumerate(words)]
    return r"""
with t(k, label, base, j, word, must_at, must_n) as (values """ + ", ".join(rows) + r"""),
d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents),
v as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from d where len(words) > 0),
w as (select * from v where word in (select word from t)),
n as (select count(*) as n from d),
df as (select word, count(distinct doc_id) as c from w group by word),
idf as (select distinct t.word, ln((n.n + 1) / (coalesce(df.c, 0) + 1)::double) as x from t cross join n left join df on df.word = t.word),
tot as (select t.k, sum(idf.x) as total from t join idf using (word) group by t.k),
a as (select w.doc_id, t.k, any_value(t.label) as label, any_value(t.base) as base, w.i - t.j as at, any_value(t.must_at) as must_at,
        sum(idf.x) as weight, count(*) filter (where t.j >= t.must_at and t.j < t.must_at + t.must_n) as must, any_value(t.must_n) as must_n
      from w join t on w.word = t.word join idf on idf.word = t.word group by w.doc_id, t.k, w.i - t.j),
f as (select a.*, a.at + a.must_at as start, a.weight / tot.total as share from a join tot using (k) where a.must = a.must_n),
g as (select doc_id, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word, max(start) filter (where base) as last_word,
        array_to_string(list_sort(list_distinct(list(label) filter (where base))), ',') as base_labels,
        array_to_string(list_sort(list_distinct(list(label))), ',') as labels, max(share) as score from f group by doc_id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(g.n_base, 0)::bigint as n_base, g.first_word::bigint as first_word,
       g.last_word::bigint as last_word, coalesce(g.base_labels, '') as base_labels, coalesce(g.labels, '') as labels,
       round(coalesce(g.score, 0), 6) as score
from d left join g using (doc_id)
"""
