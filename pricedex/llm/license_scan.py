"""Licence scan: base phrases by place, and a positional index of the licences' rarest words.

Templates are short licence notices without their variable parts.  Document frequencies of all template words are counted over the
whole corpus.  Each template stands in the index under the word of highest IDF among its mandatory key phrases; a file looks
up its occurrences of such words, and a template's postings are intersected with the words around by relative
position.  It is found where all its key phrases stand word by word and the words of highest IDF (ANCHORS of them) at their places
have at least half of their IDF weight.

Each occurrence is judged where its text is read, so only labels found are shuffled: copies and repeated words meet in no group.

Cases: null and empty texts have no words and score 0; equal rows get equal results, repeated or null ids with different texts are
told apart by the text; ties of document frequency go by the word; long texts are read whole; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricedex.llm.columns import ascii_lower, let

ANCHORS = 6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    """A notice in lower-case words, its label, and the phrases in it that must stand word by word."""

    label: str
    text: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the license", ("except in compliance with the license",)),
    Template("artistic", "licensed under the artistic license", ("artistic license",)),
    Template(
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("boost", "distributed under the boost software license", ("boost software license",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by", "this work is licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("cc0", "released under the creative commons zero public domain dedication", ("creative commons zero",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of", ("free software", "you can redistribute it")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template(
        "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "to any person obtaining a copy"),
    ),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("public-domain", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def base_places(docs: DataFrame, base: dict[str, str]) -> DataFrame:
    """docs (text, ...) with n_words, n_base, first_word, last_word and found_base, the sorted labels of the phrases found; without text.

    Every word stands between two blanks of its own, so places of a phrase never share one and string functions count them.
    """
    out = docs.withColumn("words", word_list(F.col("text"))).withColumn("n_words", F.size("words").cast("bigint"))
    out = out.withColumn("spaced", F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).drop("words", "text")
    n_words_of = lambda part: F.floor((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2)
    found, first, last, labels = [], [], [], []
    for phrase, label in base.items():
        spaced = f" {phrase.replace(' ', '  ')} "
        here = F.floor((F.length("spaced") - F.length(F.replace("spaced", F.lit(spaced), F.lit("")))) / len(spaced))
        some = F.instr("spaced", spaced) > 0
        found.append(F.when(some, here).otherwise(0))
        first.append(F.when(some, n_words_of(F.substring_index("spaced", spaced, 1))))
        last.append(F.when(some, F.col("n_words") - n_words_of(F.substring_index("spaced", spaced, -1)) - len(phrase.split())))
        labels.append(F.when(some, F.lit(label)))
    return out.withColumns({
        "n_base": sum(found[1:], found[0]).cast("bigint"), "first_word": F.least(*first).cast("bigint"), "last_word": F.greatest(*last).cast("bigint"),
        "found_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }).drop("spaced")


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and how many hold each word of the vocabulary; the driver gets one row for each word."""
    held = F.array_distinct(F.filter(word_list(F.col("text")), lambda w: w.isin(*vocabulary)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    return counts.pop("", 0), counts


def idf_weights(n_docs: int, counts: dict[str, int], vocabulary: Sequence[str]) -> dict[str, int]:
    """Inverse document frequency in thousandths, at least 1."""
    return {w: math.floor(1000 * math.log((n_docs + 1) / (counts.get(w, 0) + 1))) + 1 for w in vocabulary}


def index_of(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(word, place, template, label, length, anchors, phrases): each template under the rarest word of its key phrases, at that word's place.

    anchors: (word, weight, places) of its ANCHORS rarest words; phrases: (place, words).
    """
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    n_docs, counts = document_frequencies(docs, vocabulary)
    weights = idf_weights(n_docs, counts, vocabulary)
    rarity = lambda w: (counts.get(w, 0), w)
    rows = []
    for k, t in enumerate(templates):
        words = t.text.split()
        parts = [p.split() for p in t.phrases]
        starts = [next(i for i in range(len(words)) if words[i : i + len(p)] == p) for p in parts]
        place = min((i for s, p in zip(starts, parts) for i in range(s, s + len(p))), key=lambda i: (rarity(words[i]), i))
        anchors = [(w, weights[w], [i for i, x in enumerate(words) if x == w]) for w in sorted(set(words), key=rarity)[:ANCHORS]]
        rows.append((words[place], place, k, t.label, len(words), anchors, list(zip(starts, parts))))
    schema = "word string, place int, template int, label string, length int, anchors array<struct<word string, weight int, places array<int>>>, phrases array<struct<place int, words array<string>>>"
    return docs.sparkSession.createDataFrame(rows, schema)


def template_matches(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(key, label, share) of docs (key, text): templates found, with the matched share of their weight.

    Occurrences of the index's words come with the words around them, as many as the longest template has; words and
    phrases of a template are then at fixed places of that list.  Nothing is shuffled.  The index has a row for each template.
    """
    index = index_of(docs, templates)
    lookups = sorted({r.word for r in index.select("word").collect()})
    reach = max(len(t.text.split()) for t in templates) - 1
    pad = F.array_repeat(F.lit(""), reach)
    places = lambda words: F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*lookups), i)))
    near = lambda words: F.transform(places(words), lambda i: F.slice(words, i + 1 - reach, 2 * reach + 1))
    seen = docs.select("key", F.explode(let(F.concat(pad, word_list(F.col("text")), pad), near)).alias("around"))
    hits = seen.withColumn("word", F.col("around")[reach]).join(F.broadcast(index), "word")
    aligned = hits.withColumn("here", F.slice("around", reach + 1 - F.col("place"), F.col("length")))
    stands = F.forall("phrases", lambda p: F.slice(F.col("here"), p["place"] + 1, F.size(p["words"])) == p["words"])
    held = lambda a: F.exists(a["places"], lambda i: F.get(F.col("here"), i) == a["word"])
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    judged = aligned.where(stands).select(
        "key", "label", total(F.transform("anchors", lambda a: F.when(held(a), a["weight"]).otherwise(0))).alias("matched"), total(F.col("anchors.weight")).alias("all")
    )
    return judged.where("2 * matched >= all").select("key", "label", (F.col("matched") / F.col("all")).alias("share"))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    score: 1 with a base phrase, else the largest matched share of a template found, else 0.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(text.cast("binary"))).alias("key"))
    matches = template_matches(keyed, templates).groupBy("key").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    rows = base_places(keyed, base).join(matches, "key", "left")
    every = F.array_sort(F.array_distinct(F.concat("found_base", F.coalesce("own", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("found_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score")
    )
