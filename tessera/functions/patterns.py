"""Dimension tables of the measurements: patterns, phrases and ranges.

Fixed values: results are comparable with published measurements only if these stay as they are.
Patterns are in the syntax that Python and Java share; flags() adds what makes Java read them alike.
"""

from __future__ import annotations

import re
from functools import cache

# Fixed values ------------------------------------------------------------

#: Words in the Python sense: apostrophes inside, Unicode letters and digits.
WORD = r"\b[\w']+\b"
#: The same count with explicit classes, which every engine reads alike.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
SENTENCE_END = r"[.!?]+(?:\s+|$)"

CONTRASTIVE_NEGATION = {
    "not_x_but_y": r"\b(?:is|are|was|were|be|being|been|it's|it is|this is|that is)?\s*not\s+(?!only\b|just\b|merely\b|simply\b)[^.!?\n;:]{1,120}?\s+but\s+[^.!?\n]{1,160}",
    "not_just_but": r"\b(?:it'?s|it is|this is|that is|they are|we are|you are)?\s*not\s+(?:just|merely|simply|only)\s+[^.!?\n;:]{1,140}?\s+(?:but|but also)\s+[^.!?\n]{1,160}",
    "isnt_just_its": r"\b(?:it|this|that)\s+isn'?t\s+(?:just|merely|simply|only)\s+[^.!?\n;:]{1,140}?\s*(?:--|—|-|;|,)?\s*(?:it'?s|it is|this is|that is)\s+[^.!?\n]{1,160}",
    "not_x_its_y": r"\b(?:it'?s|it is|this is|that is|they are|we are|you are)\s+not\s+(?!only\b|just\b|merely\b|simply\b)[^.!?\n;:]{1,140}?\s*(?:--|—|-|;|,)\s*(?:it'?s|it is|this is|that is|they are|we are|you are)\s+[^.!?\n]{1,160}",
}
STOCK_LEXICON = {
    "delve": r"\bdelv(?:e|es|ed|ing)\b",
    "tapestry": r"\btapestr(?:y|ies)\b",
    "testament_to": r"\btestament\s+to\b",
    "important_to_note": r"\bit'?s\s+important\s+to\s+note\b",
    "worth_noting": r"\b(?:it'?s\s+)?worth\s+noting\b",
    "underscore": r"\bunderscor(?:e|es|ed|ing)\b",
    "nuanced": r"\bnuanc(?:e|ed|es)\b",
    "multifaceted": r"\bmultifaceted\b",
    "intricate": r"\bintric(?:ate|ately|acies|acy)\b",
    "robust": r"\brobust(?:ly|ness)?\b",
    "seamless": r"\bseamless(?:ly)?\b",
    "landscape": r"\blandscape\b",
    "realm": r"\brealm\b",
    "journey": r"\bjourney\b",
    "navigate": r"\bnavigat(?:e|es|ed|ing|ion)\b",
    "foster": r"\bfoster(?:s|ed|ing)?\b",
    "elevate": r"\belevat(?:e|es|ed|ing|ion)\b",
    "unlock": r"\bunlock(?:s|ed|ing)?\b",
    "comprehensive": r"\bcomprehensive(?:ly)?\b",
    "moreover": r"\bmoreover\b",
    "ultimately": r"\bultimately\b",
}
CANDIDATE_LEXICON = {
    "meticulous": r"\bmeticulous(?:ly|ness)?\b",
    "commendable": r"\bcommendable\b",
    "pivotal": r"\bpivotal\b",
    "burgeoning": r"\bburgeoning\b",
    "paradigm": r"\bparadigms?\b",
    "transformative": r"\btransformative\b",
    "tailored": r"\btailored\b",
    "harness": r"\bharness(?:es|ed|ing)?\b",
    "unwavering": r"\bunwavering(?:ly)?\b",
    "captivate": r"\bcaptivat(?:e|es|ed|ing|ingly)\b",
    "kaleidoscope": r"\bkaleidoscope\b",
    "symphony": r"\bsymphony\b",
}
STOCK_OPENERS = {
    "great_question": r"^\s*(?:great|excellent|good)\s+question[.!]?\b",
    "certainly": r"^\s*certainly[,.!]\s+",
    "sure": r"^\s*sure[,.!]\s+",
    "happy_to_help": r"^\s*(?:i'?d\s+be\s+)?happy\s+to\s+help\b",
    "here_are": r"^\s*here\s+(?:are|is)\s+",
}
STOCK_CLOSERS = {
    "hope_this_helps": r"\bi\s+hope\s+(?:this|that)\s+helps[.!]?\s*$",
    "in_conclusion": r"\bin\s+conclusion[,:]?\s+[^.!?]{0,180}[.!?]?\s*$",
    "overall": r"(?:^|(?<=[.!?]\s)|\n\s*)overall,\s+[^.!?]{0,180}[.!?]?\s*$",
    "to_summarize": r"\bto\s+summari[sz]e[,:]?\s+[^.!?]{0,180}[.!?]?\s*$",
    "let_me_know": r"\blet\s+me\s+know\s+if\s+you(?:'d)?\s+(?:like|need|want)\b[^.!?]*[.!?]?\s*$",
}
PUNCTUATION = {
    "em_dash": r"—|--",
    "colon": r":",
    "semicolon": r";",
    "ellipsis": r"\.\.\.|…",
    "exclamation": r"!",
    "question": r"\?",
}
_TRIAD_ITEM = r"(?!and\b|or\b)(?:[a-z][\w'-]*)(?:\s+(?:of|the|a|an|to|for|with|in|on|and|or|[a-z][\w'-]*)){0,3}"
RULE_OF_THREE = rf"\b{_TRIAD_ITEM}\s*,\s*{_TRIAD_ITEM}\s*,?\s+(?:and|or)\s+{_TRIAD_ITEM}\b"
TRIAD_COMPLETION = rf"\b{_TRIAD_ITEM}\s*,\s*{_TRIAD_ITEM}(?P<connector>\s*,?\s+(?:and|or)\s+|(?=[.!?;:\n]|$))"
TRIAD_CONNECTOR = r"\s*,?\s+(?:and|or)\s+"
BOUNDARY = r"(?:^|[.!?;:\n]\s+)"
CODE_WORDS = r"\b(?:def|class|import|from|return|lambda|const|let|var)\b"
ASSIGNMENT = r"\b[a-zA-Z_][\w.]*\s*="

NEUTRAL_CONTROLS = ("for example", "such as", "in particular", "as a result")
NEUTRAL_COMMON = ("the", "a", "of the", "number of", "in the", "to the", "is a")

DISCOVERED = {
    "conversation_greeting": r"\b(?:hey there|hi there|hey!|sure,?|certainly,?|great question)\b",
    "process_framing": r"\b(?:step[- ]by[- ]step|problem step by step|to solve|let's solve|let us solve)\b",
    "additive_transition": r"\b(?:also|additionally|moreover|however|therefore|thus|typically)\b",
    "prescriptive_instruction": r"\b(?:should|need to|consider|ensure|make sure|must)\b",
    "followup_offer": r"\b(?:you can|if you want|happy to help|i(?:'|’)m glad)\b",
    "response_constraint": r"\b(?:your response|your answer|must)\b",
    "code_boilerplate": r"\b(?:def|class|import|return|const|let|var|function)\b",
    "quantity_time_recipe": r"\b(?:cup|cups|minute|minutes|hour|hours|degrees|tablespoon|tablespoons|teaspoon|teaspoons)\b",
    "benefit_intensifier": r"\b(?:significantly enhance|greatly enhance|greatly benefit|significantly|greatly)\b",
    "careful_reasoning": r"\b(?:think carefully|let's think|let us think|carefully first)\b",
}
DISCOVERED_INITIATORS = {
    "conversation_greeting": ("hey", "hi", "sure", "certainly", "great"),
    "process_framing": ("step", "problem", "to", "let's", "let"),
    "additive_transition": ("also", "additionally", "moreover", "however", "therefore", "thus", "typically"),
    "prescriptive_instruction": ("should", "need", "consider", "ensure", "make", "must"),
    "followup_offer": ("you", "if", "happy", "i'm"),
    "response_constraint": ("your", "must"),
    "code_boilerplate": ("def", "class", "import", "return", "const", "let", "var", "function"),
    "quantity_time_recipe": ("cup", "cups", "minute", "minutes", "hour", "hours", "degrees", "tablespoon", "teaspoon"),
    "benefit_intensifier": ("significantly", "greatly"),
    "careful_reasoning": ("think", "let's", "let", "carefully"),
}
#: Discovered families whose opportunities are line or sentence starts; the others start at any token.
AT_SENTENCE_START = ("conversation_greeting", "additive_transition", "careful_reasoning")
INITIATORS = {
    "contrastive_negation": ("not just", "not only", "it is not", "it's not", "this is not", "that is not"),
    "stock_lexicon": ("delve", "tapestry", "testament", "important", "worth", "underscore", "nuanced", "multifaceted", "intricate", "robust", "seamless", "landscape", "realm", "journey", "navigate", "foster", "elevate", "unlock", "comprehensive", "moreover", "ultimately"),
    "candidate_lexicon": ("meticulous", "commendable", "pivotal", "burgeoning", "paradigm", "transformative", "tailored", "harness", "unwavering", "captivate", "captivating", "captivated", "kaleidoscope", "symphony"),
    "stock_openers": ("great", "excellent", "good", "certainly", "sure", "happy", "here"),
    "stock_closers": ("i", "in", "overall", "to", "let"),
    "rule_of_three": (", and", ", or", "and", "or"),
}

_PRON, _BE = r"(?:it|they|this|that)", r"(?:is|are|was|were)"
_BE_NOT = r"(?:is\s+not|are\s+not|was\s+not|were\s+not|isn't|aren't|wasn't|weren't|ain't)"
_START = r"(?:(?<=^)|(?<=[.?!]\s))"
_REPORTED = r"(?![^.?!]{0,80}\b(?:knew|know|thought|think|said|says|told|heard|learned)\b[^.?!]{0,40}?\bthat\b)"
#: Surface forms of contrast, on text whose quotes and dashes are plain.
SURFACE_CONTRASTS = {
    "RE_NOT_BUT": rf"\b(?:(?:{_BE_NOT})|not(?!\s+(?:that|only)\b))\s+(?:(?!\bbut\b|[.?!]).){{1,100}}?[,;:]\s*but\s+(?!when\b|while\b|which\b|who\b|whom\b|whose\b|where\b|if\b|that\b|as\b|because\b|although\b|though\b|till\b|until\b|unless\b|here\b|there\b|then\b|my\b|we\b|I\b|you\b|it\s+seems\b|it\s+appears\b|it\s+felt\b|it\s+looks?\b|anything\b)",
    "RE_NOT_DASH": rf"\b(?:\w+n't|not)\s+(?:just|only|merely)?\s+(?:(?![.?!]).){{1,160}}?(?:-|\s-\s|[—–])\s*{_PRON}\s+(?:(?:'re|are|'s|is|were|was)\b|(?!'re|are|'s|is|were|was)[*_~]*[a-z]\w*)",
    "RE_PRON_BE_NOT_SEP_BE": rf"{_START}\s*[\"']?(?:(?:{_PRON}\s+{_BE}\s+not)|(?:{_PRON}\s+{_BE}n't)|(?:it's|they're|that's)\s+not)\b[^.?!]{{0,160}}[.;:?!]\s*[\"']?{_PRON}\s+(?:{_BE}|(?:'s|'re))\b(?!\s+not\b)",
    "RE_NP_BE_NOT_SEP_THEY_BE": rf"{_START}\s*{_REPORTED}(?!\s*not\s+without\b)(?![^.?!]{{0,50}}\bnot\s+put\b)[^.?!]{{0,160}}?\b(?:{_BE_NOT})\b[^.?!]{{0,160}}[.;:?!]\s*[\"']?{_PRON}\b(?:'re|\s+(?:are|were|is|was))\b(?!\s+not\b)",
    "RE_NO_LONGER": rf"{_START}\s*[^.?!]{{0,160}}\bno\s+longer\b[^.;:?!]{{0,160}}[.;:?!]\s*(?:it|they|this|that)\s+(?:is|are|was|were)\b(?!\s+not\b)",
    "RE_NOT_JUST_SEP": rf"{_START}\s*[\"']?{_PRON}\b(?:'s|'re|\s+(?:is|are|was|were))?\s+not\s+just\b[^.?!]{{0,160}}[.?!]\s*[\"']?{_PRON}\b(?:'s|'re|\s+(?:is|are|was|were))\b(?!\s+not\b)",
    "RE_NOT_PERIOD_SAMEVERB": rf"{_START}[^.?!]*?\b(?:do|does|did)n't\b\s+(?:(?:\w+\s+){{0,2}})([a-z]{{3,}})\b[^.?!]*[.?!]\s*{_PRON}\s+\1(?:ed|es|s|ing)?\b",
    "RE_SIMPLE_BE_NOT_IT_BE": rf"{_START}\s*[\"']?(?!he\b|she\b|i\b|you\b|we\b){_REPORTED}[^.?!]{{0,160}}?\b{_BE_NOT}\b[^.?!]{{0,160}}[.;:?!]\s*[\"']?it(?:'s|\s+(?:is|are|was|were))\b",
    "RE_EMBEDDED_NOT_JUST_SEP": rf"{_START}[^.?!]{{0,80}}?\b(?:(?:it|they)\s+(?:is|are)|(?:it's|they're))\s+not\s+just\b[^.?!]{{0,160}}[.?!]\s*(?:(?:it|they)\s+(?:is|are)|(?:it's|they're))\b",
    "RE_DIALOGUE_NOT_JUST": rf"[\"']?{_PRON}(?:'re|'s|\s+(?:are|is|was|were))\s+not\s+just\b[^\"']{{0,160}}[\"']?\s*(?:[^.?!]{{0,80}}\b(?:said|asked|whispered|muttered|replied|added|shouted|cried)\b[^.?!]{{0,80}}[.?!]\s*)?[\"']?{_PRON}(?:'re|'s|\s+(?:are|is|was|were))\s+[*_~]?[a-z]\w*",
}
#: Least and largest values that scores are scaled by, and their weights.
SCORE_RANGES = {
    "words": (2.1214882577844882, 43.924784489934034),
    "trigrams": (-0.027052241145113065, 1.2293612202273094),
    "contrast": (-0.0323480255696472, 0.8881555162544392),
}
SCORE_WEIGHTS = {"words": 0.60, "contrast": 0.25, "trigrams": 0.15}
QUOTES = "‘’‚‛′ʼ＇`"

#: Marks of code and of scraped pages, and words that connect or intensify, in the quality penalty.
CODE_MARKS = (".css", ".html", ".js", ".json", ".lua", ".md", ".py", ".txt", ".xml", "application/", "argument", "encapsulat", "prefix", "schema", "twitter", "unref", "wikidata", "wikivocab", "xterm")
CONNECTORS = ("and", "or", "but")
INTENSIFIERS = ("even", "extremely", "often", "occasionally", "pretty", "quite", "sometimes", "very")
# Penalties: for each occurrence, for a share (times the factor, up to a most), or above a free share.
PENALTY_BLANK = 1.0
PENALTY_CODE_MARK, PENALTY_SYMBOL_RUN, PENALTY_GLUED_DATE, PENALTY_REPEATED_MARK, PENALTY_CAPITALS = 0.55, 0.25, 0.55, 0.6, 0.25
PENALTY_CHANGELOG, PENALTY_GAMES_PHRASE = 0.6, 0.6
PENALTY_SYMBOL_SHARE, PENALTY_MOST_SYMBOLS = 8.0, 2.0
PENALTY_FEW_LETTERS, PENALTY_LEAST_LETTERS = 1.0, 0.55
PENALTY_TITLE_RUN, PENALTY_FREE_TITLE_RUN = 0.12, 4
PENALTY_LEAST_WORDS = 8
PENALTY_FREE_TITLES, PENALTY_TITLES = 0.25, 2.0
PENALTY_FREE_CONNECTORS, PENALTY_CONNECTORS = 0.16, 3.0
PENALTY_FREE_INTENSIFIERS, PENALTY_INTENSIFIERS = 0.08, 4.0

STAGES = ("base", "sft", "dpo", "final")

TEXT_FIELDS = ("text", "messages", "response", "completion", "answer", "content", "output", "solution", "outputs")
PROMPT_FIELDS = ("prompt", "instruction", "question", "input", "query", "messages", "source_prompt")
CHOSEN_FIELDS = ("chosen", "accepted", "preferred", "winner")
REJECTED_FIELDS = ("rejected", "discarded", "non_preferred", "loser")
ID_FIELDS = ("id", "uid", "uuid", "doc_id", "document_id", "source_id")
PAIR_ID_FIELDS = ("pair_id", "pair.id", "preference_pair_id", "prompt_id")
METADATA_FIELDS = ("source", "source_dataset", "stratum", "provenance", "text_role", "domain", "dataset", "dataset_source", "data_source", "original_dataset", "preference_type", "chosen_model", "rejected_model", "version", "created", "added")
JSON_FIELDS = ("metadata", "doc", "attributes", "chat_template_kwargs")
MAP_TEXT_FIELDS = ("content", "text", "value", "response")
STRATA = (
    ("code", ("stack_edu", "cranecode", "code", "github")),
    ("scientific", ("olmocr", "science", "scientific", "paper", "arxiv")),
    ("wiki", ("wiki", "wikipedia")),
    ("forums_qa", ("forum", "reddit", "stackexchange", "stack_exchange", "qa", "q&a")),
    ("web_cc", ("common_crawl", "cc-main", "full_cc", "dclm", "c4", "web", "crawl")),
)

# End of fixed values -----------------------------------------------------

FAMILIES = {
    "contrastive_negation": CONTRASTIVE_NEGATION,
    "stock_lexicon": STOCK_LEXICON,
    "candidate_lexicon": CANDIDATE_LEXICON,
    "stock_openers": STOCK_OPENERS,
    "stock_closers": STOCK_CLOSERS,
    "punctuation": PUNCTUATION,
}


def phrase(words: str) -> str:
    """The pattern of a phrase, with any white space between its words."""
    return r"\b" + r"\s+".join(words.split()) + r"\b"


def neutral(group: str) -> dict[str, str]:
    phrases, prefix = (NEUTRAL_CONTROLS, "neutral_") if group == "controls" else (NEUTRAL_COMMON, "neutral_common_")
    return {prefix + p.replace(" ", "_"): phrase(p) for p in phrases}


@cache
def opportunity_specs() -> dict[str, tuple[str, tuple[str, ...]]]:
    """Feature to (kind of opportunity, initiators)."""
    out = {
        "contrastive_negation": ("clause_boundary", INITIATORS["contrastive_negation"]),
        "stock_lexicon": ("token_start", INITIATORS["stock_lexicon"]),
        "candidate_lexicon": ("token_start", INITIATORS["candidate_lexicon"]),
        "stock_openers": ("document_start", INITIATORS["stock_openers"]),
        "stock_closers": ("final_clause_boundary", INITIATORS["stock_closers"]),
        "stock_openers_closers": ("document_or_final_boundary", INITIATORS["stock_openers"] + INITIATORS["stock_closers"]),
        "rule_of_three": ("rule_of_three_completion", INITIATORS["rule_of_three"]),
    }
    for group, pool, phrases in (("controls", "neutral_controls", NEUTRAL_CONTROLS), ("common", "neutral_common_controls", NEUTRAL_COMMON)):
        out |= {name: ("token_start", (p,)) for name, p in zip(neutral(group), phrases, strict=True)}
        out[pool] = ("token_start", phrases)
    for name, initiators in DISCOVERED_INITIATORS.items():
        out[f"discovered_{name}"] = ("line_or_sentence_start" if name in AT_SENTENCE_START else "token_start", initiators)
    return out


def flags(pattern: str) -> str:
    """As Java must read a pattern that Python compiles with IGNORECASE, MULTILINE and UNICODE."""
    return "(?imdU)" + pattern.replace("(?P<", "(?<")


@cache
def needles(pattern: str) -> tuple[str, ...]:
    """Texts of which any match must hold one, case-folded; none if the pattern demands no literal."""

    def best(items) -> tuple[str, ...]:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            if name == "AT" or name == "ASSERT_NOT":
                continue
            if run:
                found.append((run.casefold(),))
                run = ""
            if name == "SUBPATTERN":
                found.append(best(arg[-1]))
            elif name == "BRANCH":
                each = [best(b) for b in arg[1]]
                found.append(tuple(dict.fromkeys(n for b in each for n in b)) if all(each) else ())
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                found.append(best(arg[2]))
        return max(filter(None, found), key=lambda f: min(map(len, f)), default=())

    return best(re._parser.parse(pattern, re.I | re.M | re.U))
