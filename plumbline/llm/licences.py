"""Licence notices in texts: a trained paragraph classifier, confirmed by templates.

Paragraphs are all lines of all texts, and notices wrapped over several lines.
The latter are found by the templates: neighbouring lines, with no blank one between, of
which each adds word pairs (also across the line ends) to the cover of a template, until
``COVER`` is reached. Of runs that overlap, the one that covers most pairs counts, the
shortest of these first; its lines make one paragraph, known by its first line. Their
features are pairs and triples of words (lower case, without marks, years alike) and single
words that hold a stem. A logistic regression over the families is trained on the templates, on
sentences that name a family, on shortened and disturbed copies of both, on notices of no family
and on sentences that only speak of licences, all of them fixed; nothing is learned from the
corpus. A temperature, fitted on copies kept out of training, calibrates its probabilities; below
``SURE`` the family is ``unknown``. A prediction is confirmed if the paragraph covers at least
``COVER`` of the word pairs of one of the family's templates, or grants something (``GRANT``)
under one of the family's ``NAMES``; an unconfirmed one is ``unknown`` as well.

A paragraph that grants under the names of several families is judged once for each, with the
names of the others left out, and gives a row for each.

Of most texts and lines the weights of their n-grams alone show that the model is sure to find no notice
(``_open``), and their word pairs that no template is covered (``_covers``). These go no further; both
bounds are sound, so they would give no row anyway.

Texts are worked on by expressions and joins only. The model has some thousand features, so its
table is small by construction and is broadcast. Training happens on the driver.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import rows
from plumbline.sources.pinning import pin

#: Public licence notices by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in "
        "compliance with the License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "You may use it under the terms of the GNU General Public License version 2 as published by "
        "the Free Software Foundation.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely",
    ),
    "WTFPL": (
        "This work is free under the terms of the Do What The Fuck You Want To Public License, "
        "Version 2, as published by Sam Hocevar.",
    ),
    "Artistic-2.0": (
        "Distributed under the terms of the Artistic License 2.0.",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
        "International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
}
#: Names of the families in running text, SPDX ids among them, lower case.
NAMES = {
    "MIT": ("mit",),
    "Apache-2.0": ("apache-2.0", "apache 2.0", "apache license version 2.0", "apache license 2.0"),
    "GPL-2.0": ("gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gplv2", "gpl v2", "gpl version 2"),
    "GPL-3.0": ("gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gplv3", "gpl v3", "gpl version 3"),
    "LGPL-2.1": ("lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgplv2.1"),
    "LGPL-3.0": ("lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "lgplv3"),
    "AGPL-3.0": ("agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "agplv3"),
    "BSD": ("bsd", "bsd-2-clause", "bsd-3-clause", "0bsd"),
    "ISC": ("isc",),
    "MPL-2.0": ("mpl-2.0", "mpl 2.0", "mozilla public license 2.0"),
    "EPL-2.0": ("epl-2.0", "eclipse public license"),
    "Unlicense": ("unlicense",),
    "BSL-1.0": ("bsl-1.0", "boost software license"),
    "Zlib": ("zlib",),
    "WTFPL": ("wtfpl",),
    "Artistic-2.0": ("artistic-2.0", "artistic license 2.0"),
    "CC0-1.0": ("cc0-1.0", "cc0"),
    "CC-BY-NC-4.0": ("cc-by-nc-4.0", "cc by-nc 4.0"),
    "CC-BY-SA-4.0": ("cc-by-sa-4.0", "cc by-sa 4.0"),
    "CC-BY-ND-4.0": ("cc-by-nd-4.0", "cc by-nd 4.0"),
    "CC-BY-4.0": ("cc-by-4.0", "cc by 4.0"),
}
#: One of these words grants what the names beside it say.
GRANT = (
    "licensed", "licenced", "released", "distributed", "available", "dual",
    "dual-licensed", "spdx-license-identifier", "unlicense",
)
#: Sentences that name a family, for training.
NAMING = (
    "Licensed under {}", "Released under the {} license", "Dual licensed under the {} licenses",
    "SPDX-License-Identifier: {}", "Available under the {} license", "Distributed under {}",
    "Available under {}", "Released under {}", "This file is distributed under the terms of {}",
)
#: Notices of no family.
UNKNOWN = (
    "All rights reserved. See the license file for terms.",
    "Licensed under a custom license agreement.",
    "This file is distributed under a proprietary license.",
    "Copyright held by the authors, used with permission.",
    "Use is subject to the license terms of the owner.",
    "Copyright 2019 by the owner. All rights reserved.",
    "Copyright (c) 2001 the author.",
    "Licensed under a licence of its own.",
    "Released under other license terms.",
    "Distributed under the license of the publisher.",
)
#: Sentences that speak of such things but are no notices.
NEGATIVES = (
    "You need a driving license to rent a car.",
    "You do not need a license for this boat.",
    "She lost her fishing licence last summer.",
    "The police took away his driving license.",
    "A licence is needed to sell wine in this town.",
    "The bar had its liquor license renewed.",
    "The restaurant is licensed to serve beer until midnight.",
    "He is a licensed plumber from the next village.",
    "They asked for permission to leave the room.",
    "Without permission nobody may enter the garden.",
    "Her parents gave their permission for the trip.",
    "Copyright law was debated in parliament for years.",
    "The copyright of old songs is a matter of dispute.",
    "A lawyer explained what copyright means for writers.",
    "The court ruled that no copyright had been breached.",
    "Redistribution of wealth is an old idea.",
    "The redistribution of land took a decade.",
    "The park is in the public domain of the city.",
    "A licensing fee was paid to the broadcaster.",
    "Poetic licence allows the author a great deal.",
    "The license plate was covered in mud.",
    "The film had been released in the spring.",
    "Leaflets were distributed under the bridge.",
    "The report is available under the old title.",
    # lines of ordinary text: pairs of common words say nothing of licences
    "The of the and to the in the a of the by the with the that the this is at an it be of this in this "
    "for the from the on the as the as by for to and to and the or the is the are the you may he was.",
    "It was the end of the day and they had to go to the house by the river with the others.",
    "He said that the work on the bridge is in the hands of the town, and that this was for the best.",
    "You can find any of the following in the house: a table, a chair and the list of all the others.",
    "In the beginning of the year the use of the road was free to anyone, with or without a car.",
    "To the left of the door is a copy of the map, and on the right the names of those who made it.",
    "This program is for the whole family, and it may be seen by all, at any time of the day.",
    "The terms of the peace were hard, as published by the papers of the time, and all had to pay.",
    "Of this and of that, by an old friend or by the other, in any case it is not for you or for me.",
)
#: Sentences that name a family and are no notices.
ASIDE = (
    "A professor from {} lost his fishing licence", "The {} people asked for permission to leave",
    "Copyright was the subject of a talk on {} last year",
    "He studied at {} in the city", "The {} people came to the house", "Er fuhr {} der Bahn nach Hause",
    "They spoke of {} and of other things", "{} was founded by the town in the spring",
    "Das Haus {} dem Garten", "Sie kam {} ihm", "{}", "x {} y",
)
#: Single words that hold one of these are features.
STEMS = (
    "licen", "copyright", "permission", "redistribut", "mozilla public", "creative commons",
    "public domain", "unencumbered",
)
#: A year, or years from one to another.
YEAR = r"^(19|20)[0-9]{2}(-(19|20)?[0-9]{2})?$"
#: A word broken after a hyphen: what lies between its parts, and the second part.
BROKEN = r"(?<=[A-Za-z])-(\r?\n[^A-Za-z0-9\n]*)([A-Za-z0-9.+-]+)"
#: Lines of wrapped notices that may be broadcast; more are joined by shuffle.
BROADCAST = 200_000
SURE = 0.6
COVER = 0.6
SEED = 13


# ---------------------------------------------------------------- features in Python


def words(text: str) -> list[str]:
    bare = [w.strip(".-+") for w in re.split(r"[^a-z0-9.+-]+", text.lower())]
    return [re.sub(YEAR, "0000", w) for w in bare if w]


def grams(found: list[str]) -> set[str]:
    out = {" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)}
    names = {n for ns in NAMES.values() for n in ns}
    return {g for g in out if " " in g or g in names or any(s in g for s in STEMS)}


def pairs(found: list[str]) -> set[str]:
    return {" ".join(p) for p in zip(found, found[1:])}


class Model:
    """Multinomial logistic regression on n-grams, with a temperature."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        # the last two classes: a notice of no family, and no notice
        self.classes = [*TEMPLATES, "unknown", "none"]
        taught = {
            name: [*TEMPLATES[name], *[s.format(n) for n in NAMES[name] for s in NAMING]] for name in TEMPLATES
        }
        # a name that is a grant as well is a notice by itself
        for name, ns in NAMES.items():
            taught[name] += [s.format(n) for n in ns if n in GRANT for s in ("{}", "The {}")]
        spoken_of = [s.format(n) for ns in NAMES.values() for n in ns if n not in GRANT for s in ASIDE]
        taught |= {"unknown": UNKNOWN, "none": [*NEGATIVES, *spoken_of]}
        texts, label = [], []
        for c, name in enumerate(self.classes):
            for template in taught[name]:
                found = words(template)
                naming = template not in (*TEMPLATES.get(name, ()), *UNKNOWN, *NEGATIVES)
                for k in range(4 if naming else 24):
                    # the name itself stays whole
                    copy = [w for w in found if k == 0 or naming or rng.random() > 0.12]
                    noise = [f"x{rng.integers(1e6)}" for _ in range(int(rng.integers(0, 4)))] if k else []
                    texts.append(noise + copy)
                    label.append(c)
        known = set().union(*map(grams, texts))
        texts += [["x"]] * 24
        label += [len(self.classes) - 1] * 24
        self.grams = sorted(g for g in known if not re.search(r"\bx\d", g))
        at = {g: i for i, g in enumerate(self.grams)}
        x = np.zeros((len(texts), len(at) + 1), np.float32)
        x[:, -1] = 1
        for i, found in enumerate(texts):
            for g in grams(found):
                if g in at:
                    x[i, at[g]] = 1
        y = np.eye(len(self.classes), dtype=np.float32)[label]
        held = rng.random(len(texts)) < 0.25
        self.weights = self._fit(x[~held], y[~held])
        self.temperature = self._temper(x[held] @ self.weights, y[held])

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, steps: int = 600) -> np.ndarray:
        w = np.zeros((x.shape[1], y.shape[1]), np.float32)
        speed = np.zeros_like(w)
        for _ in range(steps):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            speed = 0.9 * speed - 0.3 * (x.T @ (p - y) / len(x) + 1e-4 * w)
            w += speed
        w[np.abs(w) < 0.02] = 0.0  # sparse: what hardly counts goes
        return w

    @staticmethod
    def _temper(z: np.ndarray, y: np.ndarray) -> float:
        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - (s * y).sum(1)).mean())

        return min((float(t) for t in np.geomspace(0.25, 4, 33)), key=loss)


@cache
def model() -> Model:
    """Trained once per process: what it learns from is fixed."""
    return Model()


# ---------------------------------------------------------------- on Spark


def _words(text: Column) -> Column:
    bare = F.transform(F.split(F.lower(text), r"[^a-z0-9.+-]+"), lambda w: F.btrim(w, F.lit(".+-")))
    # years begin with 1 or 2
    return F.transform(
        F.filter(bare, lambda w: w != ""),
        lambda w: F.when((w >= "1") & (w < "3"), F.regexp_replace(w, YEAR, "0000")).otherwise(w),
    )


def _among(texts) -> str:
    return "(" + ", ".join(f"'{t}'" for t in sorted(texts)) + ")"


def _begun(grams_of: list[list[str]], n: int) -> str:
    """What the n-grams begin with."""
    return _among({" ".join(g[:-1]) for g in grams_of if len(g) == n})


def _pairs_of(words_of: str, grams_of: list[list[str]]) -> str:
    """SQL for the pairs of neighbouring words; NULL where no pair asked for begins with the word."""
    made = f"CASE WHEN a IN {_begun(grams_of, 2)} THEN concat_ws(' ', a, b) END"
    return f"zip_with({words_of}, slice({words_of}, 2, size({words_of})), (a, b) -> {made})"


@cache
def _open(whole: bool) -> str:
    """SQL on ``words``: false only where the model is sure that there is no notice.

    It is asked of the words of one line or, with ``whole``, of those of all lines of a text; then
    the answer is a struct with that of ``_covers`` beside it.
    A gram lifts no class above "none" by more than its largest difference of weights. These are
    rounded up and added; as long as the sum leaves "none" at ``SURE``, so do the exact weights.
    Over a whole text only what lifts is added, so it is no less than any line's sum.
    Lines that may be judged for several families are always open.
    """
    learned = model()
    none = learned.classes.index("none")
    rest = [i for i in range(len(learned.classes)) if i != none]
    apart = (learned.weights[:, rest] - learned.weights[:, [none]]).astype(float) / learned.temperature
    lift = np.ceil(apart[:-1].max(1) * 8 + 1e-6) / 8
    spare = float(np.log((1 / SURE - 1) / np.exp(apart[-1]).sum()) - 1e-3)
    steps: dict[float, list[str]] = {}
    for gram, by, w in zip(learned.grams, lift, learned.weights):
        if w.any() and by and (by > 0 or not whole):
            steps.setdefault(float(by), []).append(gram)
    cases = " ".join(f"WHEN g IN {_among(gs)} THEN {by}D" for by, gs in sorted(steps.items()))
    grams_of = [g.split() for gs in steps.values() for g in gs]
    names = {n.split()[0] for ns in NAMES.values() for n in ns}
    known = _among({" ".join(g) for g in grams_of} | names | set(GRANT))
    longer = (
        "zip_with(p, slice(w, 3, size(w)), (a, b) -> "
        f"CASE WHEN a IN {_begun(grams_of, 3)} THEN concat_ws(' ', a, b) END)"
    )
    asked = set().union(*_templates())
    # pairs that only begin triples, and those of templates, are made as well
    made = _pairs_of("w", [*grams_of, *[g[:2] for g in grams_of if len(g) == 3], *[p.split() for p in asked]])
    lifted = f"aggregate(h, 0D, (s, g) -> s + CASE {cases} ELSE 0D END)"
    several = f"exists(h, x -> x IN {_among(GRANT)}) AND exists(h, x -> x IN {_among(names)})"
    found = f"array_distinct(filter(concat(w, p, {longer}), g -> g IN {known}))"
    judged = f"exists(array({found}), h -> {lifted} > {spare}D OR ({several}))"
    if whole:
        judged = f"named_struct('covers', {_covers('p')}, 'open', {judged})"
    # the words and pairs are worked out once
    return f"transform(array(words), w -> transform(array({made}), p -> {judged})[0])[0]"


def _templates() -> list[list[str]]:
    """The word pairs of each template, those of no family too."""
    texts = [t for ts in (*TEMPLATES.values(), UNKNOWN) for t in ts]
    return [sorted(pairs(words(t))) for t in texts]


def _covers(pairs_of: str) -> str:
    """SQL on the pairs of a whole text: false only if no template can be covered by lines of it."""
    own = _templates()
    enough = " OR ".join(f"size(filter(h, p -> p IN {_among(ps)})) >= {len(ps) * COVER}" for ps in own)
    least = min(len(ps) for ps in own) * COVER
    held = f"array_distinct(filter({pairs_of}, x -> x IN {_among(set().union(*own))}))"
    return f"exists(array({held}), h -> size(h) >= {least} AND ({enough}))"


def _sized(found: Column, n: int) -> Column:
    starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1)))
    return F.coalesce(
        F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " ")),
        F.array().cast("array<string>"),
    )


def _texts(known: DataFrame) -> DataFrame:
    """All texts but for those that can hold no notice, with ``covers`` and ``open`` of their words.

    A word broken after a hyphen counts to the line it begins in.
    """
    found = known.withColumn("text", F.regexp_replace("text", BROKEN, "-$2$1"))
    found = found.withColumn("words", _words(F.col("text")))
    # a generator, so that the words are worked out once
    found = found.select("__file", "__row", "doc_id", "text", F.explode(F.array(F.expr(_open(True)))).alias("may"))
    return found.where("may.covers OR may.open").select("__file", "__row", "doc_id", "text", "may.covers", "may.open")


def _lines(texts: DataFrame) -> DataFrame:
    """The lines of texts, each with the line after it."""
    held = texts.withColumn("lines", F.split("text", "\n"))
    after = F.slice("lines", 2, F.size("lines"))
    both = F.zip_with("lines", after, lambda a, b: F.struct(a.alias("line"), b.alias("after")))
    found = held.select("__file", "__row", "doc_id", F.posexplode(both).alias("at", "two"))
    return found.select("__file", "__row", "doc_id", "at", "two.line", "two.after")


def _wrapped(lines: DataFrame) -> DataFrame:
    """__file, __row, at, start: the lines of notices of several lines, and their first one.

    The pairs of a template that a line holds are bits of a number. A run ends where a line
    adds none, so it has no more lines than its template has pairs.
    """
    spark = lines.sparkSession
    own = _templates()
    bits = spark.createDataFrame(
        [(p, i, 1 << k, len(ps)) for i, ps in enumerate(own) for k, p in enumerate(ps)],
        "pair string, template int, bit bigint, size int",
    )
    asked = sorted(set().union(*own))
    # a pair belongs to the line of its first word
    first = F.regexp_replace(F.regexp_extract(F.lower("after"), r"[a-z0-9][a-z0-9.+-]*", 0), r"[.+-]+$", "")
    first = F.regexp_replace(first, YEAR, "0000")
    found = lines.select("__file", "__row", "at", _words(F.col("line")).alias("words"), first.alias("first"))
    found = found.where(F.size("words") > 0).select(
        "__file", "__row", "at",
        F.concat_ws(" ", F.element_at("words", -1), "first").alias("across"),
        # the words once, with the first one of the line after it
        F.expr(
            "flatten(transform(array(concat(words, array(first))), w -> array_distinct(filter("
            f"{_pairs_of('w', [p.split() for p in asked])}, p -> p IN {_among(asked)}))))"
        ).alias("pairs"),
    )
    found = found.select("__file", "__row", "at", "across", F.explode("pairs").alias("pair"))
    key = ["__file", "__row", "template"]
    held = found.join(F.broadcast(bits), "pair").groupBy(*key, "at", "size").agg(
        F.bit_or("bit").alias("mask"),
        (F.col("at") + F.max((F.col("pair") == F.col("across")).cast("int"))).alias("end"),
    )
    enough = F.col("size") * COVER
    runs = held.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*key).orderBy("at")))
    whole = Window.partitionBy(*key, "run")
    runs = runs.withColumn("all", F.bit_or("mask").over(whole)).where(F.bit_count("all") >= enough)
    ahead = whole.orderBy("at").rowsBetween(0, max(map(len, own)))
    runs = runs.withColumn("next", F.collect_list(F.struct("mask", "end")).over(ahead))

    def longer(so_far: Column, line: Column) -> Column:
        mask = so_far["mask"].bitwiseOR(line["mask"])
        more = so_far["open"] & (mask != so_far["mask"])
        return F.struct(
            F.when(more, mask).otherwise(so_far["mask"]).alias("mask"),
            F.when(more, line["end"]).otherwise(so_far["end"]).alias("end"),
            more.alias("open"),
        )

    none = F.struct(
        F.lit(0).cast("bigint").alias("mask"), F.lit(-1).alias("end"), F.lit(True).alias("open")
    )
    spans = runs.select(
        "__file", "__row", F.col("at").alias("start"), "size", F.aggregate("next", none, longer).alias("to")
    )
    spans = spans.where(F.bit_count("to.mask") >= enough).select(
        "__file", "__row", "start", F.col("to.end").alias("end"), F.bit_count("to.mask").alias("n")
    )
    # of runs that overlap, the best ones that do not
    text = Window.partitionBy("__file", "__row").orderBy("start", "end", "n")
    before = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    spans = spans.withColumn("group", F.sum("fresh").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = F.struct(
        (-F.col("n")).alias("n"), (F.col("end") - F.col("start")).alias("length"), "start", "end"
    )
    groups = spans.groupBy("__file", "__row", "group").agg(F.sort_array(F.collect_set(ranked)).alias("spans"))

    def chosen(so_far: Column, span: Column) -> Column:
        meets = F.exists(so_far, lambda x: (x["start"] <= span["end"]) & (span["start"] <= x["end"]))
        return F.when(meets, so_far).otherwise(F.concat(so_far, F.array(span)))

    empty = F.array().cast("array<struct<n:int,length:int,start:int,end:int>>")
    best = groups.select("__file", "__row", F.explode(F.aggregate("spans", empty, chosen)).alias("best"))
    return best.where("best.length > 0").select(
        "__file", "__row", F.col("best.start").alias("start"),
        F.explode(F.sequence("best.start", "best.end")).alias("at"),
    )


def paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Wrapped notices, and lines of which the model may say more than that they are none:
    identity, doc_id, paragraph, words."""
    known = rows.pick(
        rows.identified(docs), doc_id=id_column, text=text_column, __file="__file", __row="__row"
    )
    texts = pin(_texts(known))
    spans = pin(_wrapped(_lines(texts.where("covers"))))
    if spans.count() <= BROADCAST:
        spans = F.broadcast(spans)
    found = _lines(texts).join(spans, ["__file", "__row", "at"], "left").withColumn("words", _words(F.col("line")))
    found = found.where(F.col("start").isNotNull() | F.expr(_open(False)))
    found = found.groupBy("__file", "__row", F.coalesce("start", "at").cast("bigint").alias("paragraph")).agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "line"))).alias("held")
    )
    line = F.array_join(F.col("held.line"), " ")
    return pin(found.select("__file", "__row", "doc_id", "paragraph", line.alias("line"), _words(line).alias("words")))


def _parts(found: DataFrame) -> DataFrame:
    """Paragraphs with ``part`` and ``named``, once for each family that they grant under by name.

    From each copy the names of the other families are left out. A paragraph that names no
    family, or grants nothing, is one part without a family.
    """
    spoken = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    # between two words are two blanks, so that neighbouring names are both found
    spelled = {n: f" {n.replace(' ', '  ')} " for ns in NAMES.values() for n in ns}
    named = F.array_compact(F.array(*[
        F.when(F.greatest(F.lit(False), *[F.contains("spoken", F.lit(spelled[n])) for n in ns]), F.lit(f))
        for f, ns in NAMES.items()
    ]))
    grants = F.exists("words", lambda w: w.isin(*GRANT))
    none = F.array(F.lit(None).cast("string"))
    names = F.when(grants & (F.size("named") > 0), F.col("named")).otherwise(none)
    found = found.withColumn("spoken", spoken).withColumn("named", named)
    found = found.withColumn("several", F.size(names) > 1)
    found = found.withColumns({"names": names}).select(
        *[c for c in found.columns if c != "named"], F.posexplode("names").alias("part", "named")
    )
    table = F.array(*[
        F.struct(F.lit(spelled[n]).alias("name"), F.lit(f).alias("family"))
        for f, ns in NAMES.items() for n in sorted(ns, key=len, reverse=True)
    ])
    own = F.aggregate(
        table, F.col("spoken"),
        lambda text, n: F.when(n["family"] == F.col("named"), text).otherwise(F.replace(text, n["name"], F.lit("  "))),
    )
    kept = F.filter(F.split(own, " +"), lambda w: w != "")
    return found.withColumn("words", F.when(F.col("several"), kept).otherwise(F.col("words"))).drop("spoken", "several")


def licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per paragraph that is a notice, or per family of it: doc_id, paragraph, family,
    probability, coverage, confirmed.

    A paragraph's number is that of its (first) line, from 0 within its text. ``unknown`` stands for
    notices of no family, of doubtful family, or unconfirmed, and for paragraphs of which it is
    doubtful whether they are notices. A family confirmed by its name has
    coverage 1. NULL, empty and blank texts have no notices; repeated rows are scanned each for
    itself; an empty table gives no rows; NULL ids stay NULL; extra columns are ignored.
    """
    spark = docs.sparkSession
    learned = model()
    found = pin(_parts(paragraphs(docs, id_column, text_column)))
    k = len(learned.classes)
    table = spark.createDataFrame(
        [(g, [float(v) for v in w]) for g, w in zip(learned.grams, learned.weights[:-1]) if w.any()],
        "gram string, w array<double>",
    )
    key = ["__file", "__row", "doc_id", "paragraph", "part", "named"]
    split = F.array_distinct(F.concat(*[_sized(F.col("words"), n) for n in (1, 2, 3)]))
    told = found.select(*key, F.explode(split).alias("gram")).join(F.broadcast(table), "gram")
    summed = told.groupBy(*key).agg(
        *[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(k)]
    )
    bias = learned.weights[-1]
    worth = F.array(*[
        (F.coalesce(F.round(f"s{i}", 9), F.lit(0.0)) + float(bias[i])) / learned.temperature for i in range(k)
    ])
    joined = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in key]
    scores = found.select(*key).alias("p").join(summed.alias("q"), joined, "left")
    scores = scores.select(*[F.col(f"p.{c}").alias(c) for c in key], *[f"s{i}" for i in range(k)])
    scores = scores.select(*key, worth.alias("worth")).withColumn("top", F.array_max("worth"))
    whole = F.aggregate("worth", F.lit(0.0), lambda so_far, w: so_far + F.exp(w - F.col("top")))
    classes = F.array(*[F.lit(c) for c in learned.classes])
    best = F.element_at(classes, F.array_position("worth", F.col("top")).cast("int"))
    scores = scores.select(*key, best.alias("best"), (F.lit(1.0) / whole).alias("probability"))

    rows_of = [
        (name, i, p, len(pairs(words(t))))
        for name, ts in TEMPLATES.items() for i, t in enumerate(ts) for p in sorted(pairs(words(t)))
    ]
    templates = spark.createDataFrame(rows_of, "family string, template int, pair string, size int")
    told = found.select(*key, F.explode(F.array_distinct(_sized(F.col("words"), 2))).alias("pair"))
    cover = (
        told.join(F.broadcast(templates), "pair")
        .groupBy(*key, "family", "template", "size").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*key, "family").agg(F.max(F.col("n") / F.col("size")).alias("coverage"))
    )
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in key]
    same.append(F.col("p.best") == F.col("q.family"))
    surely = (F.col("best") == "none") & (F.col("probability") >= SURE)
    notices = scores.where(~surely)
    out = notices.alias("p").join(cover.alias("q"), same, "left")
    by_name = F.coalesce(F.col("p.named") == F.col("p.best"), F.lit(False))
    covered = F.when(by_name, 1.0).otherwise(F.coalesce("q.coverage", F.lit(0.0)))
    confirmed = ~F.col("p.best").isin("unknown", "none") & (F.col("p.probability") >= SURE) & (covered >= COVER)
    return out.select(
        "p.doc_id", "p.paragraph",
        F.when(confirmed, F.col("p.best")).otherwise("unknown").alias("family"),
        "p.probability", covered.alias("coverage"), confirmed.alias("confirmed"),
    )
