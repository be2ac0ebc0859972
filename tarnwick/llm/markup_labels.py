"""Labelled texts on which the classifiers of markup residue are fitted, and others on which they are tested.

No table has labels of this kind, so texts are composed here: prose with markup whose
place is known, look-alikes of it, and page furniture.  In a template ``⟦...⟧`` encloses
what is residue, and ``~`` stands for a word.  What is held out has other templates,
other words and another seed.  The number of texts is the bound of the labelled sample.
"""

from __future__ import annotations

import random
import re

#: Labelled texts that the classifiers are fitted on.
LABELLED = 1200

_WORDS = "signal river method table garden result vector paper winter model engine market number letter forest copper window harbour".split()
_OTHER = "kernel island figure ladder carbon basket planet record needle summer valley thread mirror pocket branch silver".split()

# Templates by style, for fitting.
STYLED = {
    "html": [
        "⟦<p>⟧~ ~ ~ ~.⟦</p>⟧", "⟦<h2>⟧~ ~⟦</h2>⟧", "~ ⟦<b>⟧~⟦</b>⟧ ~ ~.", "~ ⟦<em>⟧~⟦</em>⟧ ~", "⟦<a href=\"https://~.example/~\">⟧~ ~⟦</a>⟧", "⟦<div class=\"~\">⟧\n~ ~ ~\n⟦</div>⟧",
        "~⟦<br/>⟧\n~ ~", "~ ⟦&amp;⟧ ~ and 3 ⟦&lt;⟧ 4", "~⟦&nbsp;⟧~⟦&#8212;⟧~", "⟦<!-- ~ ~ -->⟧ ~", "⟦<script>var ~ = 1; ~();</script>⟧", "⟦<style>.~ { color: red }</style>⟧",
        "⟦<ul>⟧\n⟦<li>⟧~ ~⟦</li>⟧\n⟦<li>⟧~⟦</li>⟧\n⟦</ul>⟧", "⟦<pre>⟧⟦<code>⟧~ = ~(3)⟦</code>⟧⟦</pre>⟧", "⟦<img src=\"~.png\" alt=\"~\">⟧", "⟦<p>⟧~ ~ ~", "⟦<li>⟧~\n⟦<li>⟧~ ~", "x⟦<sup>⟧2⟦</sup>⟧ ~",
        "⟦<table>⟧⟦<tr>⟧⟦<td>⟧~⟦</td>⟧⟦<td>⟧4⟦</td>⟧⟦</tr>⟧⟦</table>⟧", "⟦<p>⟧~ ⟦<b>⟧~ ~⟦</p>⟧", "⟦<span style='~'>⟧~⟦</span>⟧", "⟦&lt;p&gt;⟧~ ~⟦&lt;/p&gt;⟧", "⟦<!DOCTYPE html>⟧",
    ],
    "markdown": [
        "⟦# ⟧~ ~", "⟦### ⟧~", "~ ⟦**⟧~ ~⟦**⟧ ~.", "~ ⟦*⟧~⟦*⟧ ~", "~ ⟦__⟧~⟦__⟧ ~", "~ ⟦_⟧~ ~⟦_⟧ ~", "~ ⟦`⟧~⟦`⟧ ~.", "⟦```⟧\n~ = ~\n⟦```⟧", "⟦[⟧~⟦](https://~.example)⟧", "⟦![⟧~⟦](~.png)⟧",
        "⟦- ⟧~ ~\n⟦- ⟧~\n⟦- ⟧~ ~", "⟦1. ⟧~ ~\n⟦2. ⟧~\n⟦3. ⟧~", "⟦- ⟧~\n⟦1. ⟧~ ~\n⟦2. ⟧~", "⟦> ⟧~ ~ ~", "⟦- [ ] ⟧~ ~", "⟦~~⟧~⟦~~⟧ ~", "⟦| ~ | ~ |⟧\n⟦|---|---|⟧\n⟦| 1 | 2 |⟧", "~ ~⟦[^1]⟧", "⟦⟧~ ~\n⟦=====⟧\n\n~", "~ ~\n\n⟦---⟧\n\n~",
        "⟦<⟧https://~.example/~⟦>⟧", "~ ⟦[⟧~⟦][r]⟧ ~\n\n⟦[r]: https://~.example⟧", "⟦- ⟧~\n⟦1. ⟧~ ~\n⟦2. ⟧~", "⟦**⟧~⟦**⟧\n\n⟦1. ⟧~\n⟦2. ⟧~",
    ],
    "wiki": [
        "⟦== ~ ~ ==⟧", "⟦[[~]]⟧ ~ ~", "~ ⟦[[~ ~|~]]⟧", "⟦{{~|~}}⟧ ~", "⟦''⟧~⟦''⟧ ~ ~", "⟦'''⟧~⟦'''⟧ ~", "⟦{| class=\"~\"⟧\n⟦|-⟧\n⟦| ~ || ~⟧\n⟦|}⟧", "⟦[[Category:~]]⟧", "⟦[https://~.example ~ ~]⟧", "⟦[[File:~.png|~]]⟧", "~⟦<ref>⟧~ ~⟦</ref>⟧",
    ],
    "latex": [
        "⟦\\section{~ ~}⟧", "~ ⟦\\textbf{~}⟧ ~", "~⟦~\\cite{~}⟧ ~", "~⟦\\footnote{~ ~}⟧", "⟦$~_{1} = ~^2$⟧ ~", "⟦\\[ ~_1 + 2 \\]⟧", "⟦$$\\sum ~_i$$⟧", "⟦\\begin{itemize}⟧\n⟦\\item⟧ ~ ~\n⟦\\item⟧ ~\n⟦\\end{itemize}⟧",
        "5⟦\\%⟧ of ~", "⟦\\begin{verbatim}\n~\n\\end{verbatim}⟧", "⟦\\label{~}⟧", "⟦\\emph{~ ~}⟧", "~ ⟦\\(~_2\\)⟧ ~", "⟦\\subsection*{~}⟧",
    ],
    "plain": [],
}
# What only looks like it.
ALIKE = [
    "~ < 0.05 and ~ > 3", "a List<String> or Map<Long, ~>", "the <unk> and <pad> of ~; <|endoftext|>", "C:\\temp\\new_~\\beta", "Q&A of the R&D ~", "from $81 to $149 per ~", "as in [11] and [37]", "5 * 6 * 2 is ~", "the __init__ and __main__ of ~", "a 7'' ~",
    "#1976 in ~", "• ~\n• ~ ~", "(a) ~\n(b) ~", "– ~ ~", "{\"~\": [22, 15]}", "score = ~ / (n + 31)", "~_~_~ and ~_id", "1. ~ ~\n2. ~ ~\n3. ~", "1998. ~ ~ ~", "a Box<a> or a ~<b>", "the <s> of ~", "set <title> and <object> first", "~@~.example", "~ -> ~ => ~", "f(_x_=1)", "3 | 4 | ~",
]
FURNITURE = [
    "Home | About | Contact | ~", "© 2021 ~ Ltd. All rights reserved.", "Share this ~ on social media", "Accept all cookies | Cookie settings", "Log in / Register", "Previous ~ | Next ~", "Skip to main content", "Subscribe to our newsletter", "Terms of use · Privacy policy · Imprint",
    "Posted in: ~, ~ | Leave a comment", "Copyright ~ 2019", "We use cookies to improve your experience. Accept", "Menu", "Back to top", "Follow us on ~ | RSS", "Sign up for free", "Advertisement", "Print | Email | Share", "Related articles", "Search this site",
]
# The same, held out.
STYLED_HELD = {
    "html": [
        "⟦<section id=\"~\">⟧~ ~ ~⟦</section>⟧", "⟦<h3 class='~'>⟧~⟦</h3>⟧", "~ ⟦<i>⟧~⟦</i>⟧ ~", "⟦<ol>⟧⟦<li>⟧~⟦</li>⟧⟦<li>⟧~⟦</li>⟧⟦</ol>⟧", "~ ⟦&quot;⟧~⟦&quot;⟧", "⟦<blockquote>⟧~ ~⟦</blockquote>⟧", "⟦<p>⟧~ ⟦<i>⟧~ ~⟦</p>⟧", "⟦<p>⟧⟦<s>⟧~ ~⟦</p>⟧", "⟦<hr>⟧",
    ],
    "markdown": [
        "⟦## ⟧~ ~ ~", "⟦**⟧~⟦**⟧: ~ ~", "⟦* ⟧~\n⟦* ⟧~ ~", "⟦+ ⟧~\n⟦1. ⟧~\n⟦2. ⟧~", "⟦- ⟧~\n⟦- ⟧~\n⟦1) ⟧~\n⟦2) ⟧~", "~ ⟦``⟧~ ~⟦``⟧", "⟦[⟧~ ~⟦](~/~.html)⟧", "⟦~~~⟧\n~\n⟦~~~⟧", "~ ⟦*⟧~ ~⟦*⟧.", "⟦1. ⟧~\n⟦- ⟧~\n⟦2. ⟧~",
    ],
    "wiki": ["⟦=== ~ ===⟧", "~ ⟦[[~ (~)|~]]⟧ ~", "⟦{{~}}⟧", "~ ⟦'''⟧~ ~⟦'''⟧"],
    "latex": ["⟦\\subsubsection{~}⟧", "~ ⟦\\texttt{~}⟧", "~⟦\\ref{~}⟧", "⟦$~^{2}$⟧", "⟦\\begin{enumerate}⟧\n⟦\\item⟧ ~\n⟦\\end{enumerate}⟧"],
    "plain": [],
}
ALIKE_HELD = [
    "if ~ < 4 then ~ > 9", "Set<Integer> and Pair<~, Long>", "[CLS] ~ <mask> ~", "D:\\~\\x", "B&B in ~", "cost $5 and $7", "see [3]", "2 * 3", "the __call__ of ~", "1. ~ ~ ~\n2. ~ ~", "2004. ~ ~", "a Node<i> of ~", "~_count", "◦ ~\n◦ ~", "Tree<s> ~",
]
FURNITURE_HELD = ["Start | Products | Support | ~", "All rights reserved © ~", "Read our privacy policy | Terms", "Share | Tweet | Print", "Log in", "Sign up to our newsletter", "Next ~ »"]


def _fill(template: str, rng: random.Random, words: list[str]) -> str:
    """Words for ``~``; pairs and triples of it, and one before a command, are markup and stay."""
    return re.sub(r"~{2,}|⟦~(?=\\)|~", lambda m: m[0] if len(m[0]) > 1 else rng.choice(words), template)


def _prose(rng: random.Random, words: list[str]) -> str:
    one = lambda: (" ".join(rng.choice(words + ["the", "of", "a", "is", "and", "in"]) for _ in range(rng.randrange(6, 14)))).capitalize() + rng.choice("..?")
    return " ".join(one() for _ in range(rng.randrange(1, 4)))


def texts(n: int = LABELLED, seed: int = 1, held_out: bool = False) -> list[tuple[str, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Texts with the places of their markup and of their page furniture."""
    rng = random.Random(seed)
    styled, alike, furniture, words = (STYLED_HELD, ALIKE_HELD, FURNITURE_HELD, _OTHER) if held_out else (STYLED, ALIKE, FURNITURE, _WORDS)
    out = []
    for _ in range(n):
        style = rng.choice(list(styled))
        parts: list[tuple[str, bool]] = []
        for _ in range(rng.randrange(2, 9)):
            pick = rng.random()
            if pick < 0.45 and styled[style]:
                parts.append((_fill(rng.choice(styled[style]), rng, words), False))
            elif pick < 0.60:
                parts.append((_fill(rng.choice(alike), rng, words), False))
            elif pick < 0.68:
                parts.append((_fill(rng.choice(furniture), rng, words), True))
            elif pick < 0.74:
                parts.append((" ".join(rng.choice(words).capitalize() for _ in range(rng.randrange(1, 6))), False))
            else:
                parts.append((_prose(rng, words), False))
        if rng.random() < 0.3:  # furniture comes in rows
            parts += [(_fill(rng.choice(furniture), rng, words), True) for _ in range(rng.randrange(1, 5))]
        text, marked, furnished = "", [], []
        for body, page in parts:
            text += "\n\n" if text else ""
            begin = len(text)
            for i, piece in enumerate(re.split("[⟦⟧]", body)):
                if i % 2:
                    marked.append((len(text), len(text) + len(piece)))
                text += piece
            if page:
                furnished.append((begin, len(text)))
        out.append((text, marked, furnished))
    return out
