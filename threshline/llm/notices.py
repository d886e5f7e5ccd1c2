"""Notices at the head of a file that say a machine made it or that it was taken over from elsewhere.

A notice is judged by its parts, not by whole sentences: a word of making, the name of a tool or source, and either a
request not to edit, a loss of edits, or a renewal by some build.  Parts are listed for twelve languages.  A request about
other files ("do not edit those") is no part.
"""

from __future__ import annotations

import re
import unicodedata

#: What a line of a comment begins with, and what looks like one but is an instruction to a preprocessor.
REMARK = re.compile(r"\s*(?:$|//|\#|--|;|/\*|<!--|\*|%|'\s|\{-)")
INSTRUCTION = re.compile(r"\s*\#\s*(?:define|undef|include|import|ifn?def|if|elif|else|endif|pragma|error|line|region)\b")
#: Lines that may stand before the head comment without being code: declarations of the language or encoding, guards, the package.
PREAMBLE = re.compile(r"""\s*(?:<\?(?:xml|php)\b.*|<!DOCTYPE\b.*|["']use strict["'];?|package\s+[\w.]+;?|#\s*pragma\s+once|#\s*ifndef\s+\w+|#\s*define\s+\w+|[\[{(]|---|﻿)\s*\Z""", re.I)
BLOCKS = (("/*", "*/"), ("<!--", "-->"), ("{-", "-}"), ('"""', '"""'), ("'''", "'''"))
COMMENT = re.compile(r"""\s*(?://+!?|\#+|--|;+|/\*+!?|<!--|\*|%+|'|"_?(?:comment|note|generated)"\s*:\s*"|\{-|\"{3})\s*(.*?)\s*(?:\*/|-->|",?|-\}|\"{3})?\s*$""")
#: A list number, label or mark of at most four letters before the notice.
LEAD = r"(?:\W{0,3}\w{1,4}[.):]?\s+)?"

_MADE = r"""
    auto-?\s?generated | (?:re)?generated | machine-?\s?(?:written|made|generated|produced) | transcription\ of | build\ (?:product|output|artifact|artefact)
  | (?:automatisch\ )?(?:erzeugt|generiert|erstellt) | (?:produit|générée?|créée?|genere|engendré)(?:\ automatiquement)?\ (?:par|à\ partir|depuis|avec) | généré | générée
  | generad[oa] | gerad[oa] | producid[oa]\ por | generat[oa] | prodott[oa]\ da | gegenereerd | wygenerowan\w* | сгенерирован\w* | создан\w*\ автоматически
  | 自動生成 | 生成され | により生成 | によって(?:生成|作成) | から生成 | が生成した | 自動的に作成 | 自动生成 | 自動產生 | 由.{1,60}(?:生成|产生|產生) | 자동(?:으로)?\ ?생성 | 에\ 의해\ 생성
"""
#: Words that say as much of other things; they count where the comment begins with them or with the file as their subject.
_MADE_FIRST = r"""
    (?:produced|emitted|compiled|rendered|derived|translated|transpiled|converted|exported|expanded|built|created|written|synthesi[sz]ed|assembled)\ (?:automatically\ )?(?:by|from|with|out\ of)
  | (?:output|product|result|rendering|translation|expansion|snapshot|dump|export)\ of
"""
_NO_EDIT = r"""
    (?:do\ not|don['’]t|never|not\ to\ be|should\ not\ be|must\ not\ be|no\ manual|avoid|not\ meant\ to\ be)\ (?:\w+\ ){0,2}?(?:edit\w*|modif\w+|chang\w+|patch\w*|touch\w*|alter\w*|amend\w*|tweak\w*|fix\w*|commit\w*)
        (?=\ (?:it|this|by|here|the\ file|manually|directly|in\ place)\b|\W*$|\s*[.;,!])
  | (?:edits?|changes?|modifications?)\b[^.;]{0,40}\b(?:lost|overwritten|discarded|undone|reverted|vanish|disappear) | instead\ of\ editing | (?:only|right|one)\ place\ to\ (?:change|edit)
  | nicht\ (?:\w+\ ){0,3}(?:ändern|bearbeiten|editieren|anpassen|verändern|anfassen) | (?:änderungen|bearbeitungen)\b[^.;]{0,40}\b(?:verloren|überschrieben)
  | ne\ (?:pas|jamais)\ (?:\w+\ ){0,2}(?:modifier|éditer|changer|toucher|retoucher) | modifications\b[^.;]{0,40}\b(?:perdues|écrasées)
  | no\ (?:\w+\ ){0,2}(?:editar|edite|modificar|modifique|cambiar|tocar) | não\ (?:\w+\ ){0,2}(?:edite|editar|modifique|modificar|altere|alterar) | non\ (?:\w+\ ){0,2}(?:modificare|modificarlo|editare|cambiare|toccare)
  | niet\ (?:\w+\ ){0,3}(?:bewerken|wijzigen|aanpassen) | не\ (?:\w+\ ){0,2}(?:редактир\w+|изменя\w+|правит\w+|трогат\w+) | nie\ (?:\w+\ ){0,2}(?:edytowa\w*|edytuj|zmienia\w*|modyfikowa\w*)
  | (?:編集|変更|修正|改変|更新)(?:を)?(?:しない|禁止|せず|は失われ|不可|厳禁) | 手で(?:直|編集|変更|修正)さない | (?:请勿|請勿|不要|勿|禁止|切勿)(?:手动|手動|直接)?(?:编辑|編輯|修改|改动|更改) | (?:수정|편집|변경)하지\ ?(?:마|말)
"""
_RENEWED = r"""
    (?:refreshed|regenerated|re-generated|rebuilt|recreated|re-created|renewed|rewritten|overwritten|updated|synced|synchroni[sz]ed|replaced|emitted)\ (?:automatically\ )?(?:by|on|with|at|in|during|from)\ (?:\w+\ ){0,2}?(?:every|each|any|next|nightly|release|build|job|ci|pipeline|commit|compile|deploy\w*|run)
  | re-?run\ (?:the\ )?\S+ | will\ be\ (?:overwritten|regenerated|replaced) | wird\ (?:\w+\ ){0,4}(?:überschrieben|neu\ erzeugt|aktualisiert) | sera\ (?:écrasé|régénéré)e? | se\ sobrescrib\w+ | 上書きされ | 再生成され | 将被覆盖 | 會被覆蓋 | 덮어쓰
"""
MADE, NO_EDIT, RENEWED = (re.compile(f"(?:{p})", re.I | re.X) for p in (_MADE, _NO_EDIT, _RENEWED))
MADE_FIRST = re.compile(rf"(?:\W{{0,3}}(?:\d{{1,4}}|\w{{1,4}}[.):])\s+)?\W{{0,3}}(?:(?:this|the)\ (?:file|code|module|class|source)\ (?:is|was|has\ been)\ (?:\w+\ ){{0,2}}?)?(?:{_MADE_FIRST})", re.I | re.X)
#: A file says of itself that a machine made it: enough without a request.
SELF = re.compile(
    LEAD
    + r"""(?: <auto-?generated\b | @generated\b | auto-?generated\b(?=.*(?:file|code|overwritten|edit|by\b))
      | (?:this|the)\ (?:file|code|module|source|class)\ (?:was|is|has\ been)\ (?:\w+\ ){0,2}(?:auto-?)?(?:generated|produced|created|written)\ (?:by|from|with)\b(?!\ hand)
      | (?:code|file|source|automatically)\ generated\ (?:by|from|with)\b | machine-?\s?(?:written|generated|made)\b | produced\ by\ the\ \S+\ (?:compiler|generator)\b | build\ (?:product|artifact|artefact)\b
      | (?:automatisch|maschinell)\ (?:erzeugt|generiert|erstellt)\ (?:aus|von|durch|mit)\b | (?:dieses?|diese)\ (?:datei|klasse|modul)\ wurde\ (?:\w+\ ){0,3}(?:erzeugt|generiert|erstellt)
      | (?:ce\ )?(?:fichier|code)\ (?:est\ |a\ été\ )?(?:produit|généré)\b | (?:archivo|fichero|código|arquivo)\ (?:es\ |fue\ |foi\ )?(?:generado|gerado)\b )""",
    re.I | re.X,
)
#: Said of other files or of a part of this one, or that a hand wrote it.
OTHERS = re.compile(r"\b(?:(?:edit|modify|change|patch|touch)\ (?:those|these|them|the\ (?!file\b)\w+)|edit\ this\ (?:one|file)\ instead|(?:written|maintained|kept|edited)\ (?:by\ hand|manually)|hand-?written|(?:writes|emits|produces|creates|builds|generates|reads|checks|parses)\ (?:the|an?|all)\b)", re.I)
VENDORED = re.compile(
    LEAD
    + r"""(?: upstream:\s | (?:imported|synced|mirrored|vendored|forked)\ from\ the\ \S+\ (?:release|source|upstream|project|repository)\b | (?:copied|vendored|taken|imported|borrowed|mirrored)\ (?:verbatim\ |unchanged\ )?from\ (?:upstream|the\ upstream|https?:|the\ \S+\ (?:project|library|release|repository))
      | (?:copyright\ )?(?:\(c\)|©)\ \d{4}(?:\s?-\s?\d{4})?,?\ (?:the\ )?\S+\ (?:contributors|authors|developers|project)\b
      | copyright\ (?:\(c\)\ |©\ )?\d{4}(?:\s?-\s?\d{4})?,?\ (?:the\ )?\S+\ (?:contributors|authors|developers|project)\b
      | spdx-filecopyrighttext:\ (?:\d{4}(?:-\d{4})?\ )?the\ \S+\ (?:contributors|authors|developers|project)\b
      | \S+\ (?:-|v\d\S*\ -)\ .{3,60}\blibrary,?\ version\ \d | /?!?\s?\S+\ v\d+\.\d+\.\d+\ \|\ )""",
    re.I | re.X,
)


def head(lines: list[str]) -> list[str]:
    """The texts of all comments before the first line of code, however many; a preamble is passed over."""
    out, until = [], None
    for line in lines:
        if until is None:
            if not line.strip() or PREAMBLE.match(line):
                continue
            opened = next((end for begin, end in BLOCKS if line.lstrip().startswith(begin)), None)
            keyed = COMMENT.match(line) if line.lstrip().startswith('"') else None
            if not opened and not keyed and (not REMARK.match(line) or INSTRUCTION.match(line)):
                break
            if opened:
                rest = line.lstrip()[len(opened) :]
                until = None if opened in rest else opened
        elif until in line:
            until = None
        m = COMMENT.match(line)
        text = m[1] if m else line.strip()
        if text:
            out.append(text)
    return out


def made_by_machine(text: str) -> bool:
    """Whether a comment says that the file it heads is made by a machine."""
    text = unicodedata.normalize("NFKC", text)
    if OTHERS.search(text):
        return False
    if SELF.match(text):
        return True
    return bool(MADE.search(text) or MADE_FIRST.match(text)) and bool(NO_EDIT.search(text) or RENEWED.search(text))


def is_notice(text: str) -> bool:
    return bool(VENDORED.match(text)) or made_by_machine(text)


def has_notice(lines: list[str]) -> bool:
    """Whether a comment before the first line of code is a notice; one that runs over a line end is read as a whole."""
    texts = head(lines)
    return any(map(is_notice, texts)) or any(made_by_machine(f"{a} {b}") for a, b in zip(texts, texts[1:]) if not re.search(r"[.!;。]$", a))
