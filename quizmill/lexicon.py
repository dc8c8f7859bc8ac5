"""Word lists, patterns, thresholds and message texts used by the operators.

Fixed values: results depend on these being exactly as written.
"""

from __future__ import annotations

# --- Fixed values: element patterns -----------------------------------------

EQUATION_PATTERNS = [
    r"\$[^$]+\$",
    r"\$\$[^$]+\$\$",
    r"\\begin\{equation\}.*?\\end\{equation\}",
    r"\\begin\{align\}.*?\\end\{align\}",
    r"\\begin\{matrix\}.*?\\end\{matrix\}",
    r"\\begin\{cases\}.*?\\end\{cases\}",
    r"\\frac\{[^}]+\}\{[^}]+\}",
    r"\\sum_\{[^}]*\}\^\{[^}]*\}",
    r"\\int_\{[^}]*\}\^\{[^}]*\}",
    r"\\lim_\{[^}]*\}",
    r"\b(?:\w+\s*[=≠<>≤≥±∞]+\s*\w+|\w+\s*[+\-*/∇∂]+\s*\w+)",
    r"[α-ωΑ-Ω]+",
    r"[∑∫∂∇∞±≤≥≠≈∈∉⊂⊃∪∩∧∨¬→↔∀∃]+",
]

CODE_PATTERNS = [
    r"```[^`]*```",
    r"`[^`]+`",
    r"def\s+\w+\s*\([^)]*\):",
    r"function\s+\w+\s*\([^)]*\)",
    r"class\s+\w+\s*[\{:]",
    r"for\s*\([^)]+\)\s*\{",
    r"if\s*\([^)]+\)\s*\{",
    r"while\s*\([^)]+\)\s*\{",
    r"#include\s*<[^>]+>",
    r"import\s+\w+",
    r"from\s+\w+\s+import",
    r"^\s{4,}\w+.*$",
]

NAMED_EQUATIONS = [
    ("latex_inline", r"\$([^$]+)\$"),
    ("latex_display", r"\$\$([^$]+)\$\$"),
    ("latex_equation", r"\\begin\{equation\}(.*?)\\end\{equation\}"),
    ("latex_align", r"\\begin\{align\}(.*?)\\end\{align\}"),
    ("fraction", r"\\frac\{([^}]+)\}\{([^}]+)\}"),
    ("summation", r"\\sum_\{([^}]*)\}\^\{([^}]*)\}"),
    ("integral", r"\\int_\{([^}]*)\}\^\{([^}]*)\}"),
    ("basic_equation", r"\b(\w+\s*[=≠<>≤≥±]+\s*\w+)"),
    ("symbols", r"([α-ωΑ-Ω∑∫∂∇∞±≤≥≠≈∈∉⊂⊃∪∩∧∨¬→↔∀∃]+)"),
]

NAMED_CODE = [
    ("markdown_code", "```(\\w+)?\n(.*?)\n```"),
    ("inline_code", r"`([^`]+)`"),
    ("function_def", r"(def\s+\w+\s*\([^)]*\):)"),
    ("indented_code", r"^(\s{4,}.+)$"),
]

TABLE_PATTERNS = [
    r"\|[^|]*\|[^|]*\|",
    r"┌[─┬]*┐",
    r"├[─┼]*┤",
    r"└[─┴]*┘",
    r"\+[-+]*\+",
]

FIGURE_PATTERNS = [
    r"Figure\s+\d+[:\-\s]*[^\n]*",
    r"Fig\.\s+\d+[:\-\s]*[^\n]*",
    r"Diagram\s+\d+[:\-\s]*[^\n]*",
    r"Chart\s+\d+[:\-\s]*[^\n]*",
    r"Graph\s+\d+[:\-\s]*[^\n]*",
    r"\[FIGURE\s+\d+[^\]]*\]",
    r"\[IMAGE[^\]]*\]",
    r"\[DIAGRAM[^\]]*\]",
]

SECTION_PATTERNS = [
    r"^(\d+\.?\d*\.?\d*)\s+([A-Z][^.!?]*)",
    r"^([A-Z][A-Z\s]{2,50})$",
    r"^(Introduction|Conclusion|Summary|Abstract|Overview|Background)",
    r"^(Chapter|Section|Part)\s+(\d+)[:\-\s]*([A-Z][^.!?]*)",
]

LANGUAGE_PATTERNS = {
    "python": [r"def\s+\w+", r"import\s+\w+", r"from\s+\w+\s+import", r"print\s*\("],
    "javascript": [r"function\s+\w+", r"var\s+\w+", r"let\s+\w+", r"console\.log"],
    "java": [r"public\s+class", r"public\s+static\s+void\s+main", r"System\.out\.print"],
    "c++": [r"#include\s*<[^>]+>", r"int\s+main\s*\(", r"std::"],
    "c": [r"#include\s*<[^>]+>", r"int\s+main\s*\(", r"printf"],
    "sql": [r"SELECT\s+", r"FROM\s+", r"WHERE\s+", r"INSERT\s+INTO"],
    "html": [r"<[^>]+>", r"<!DOCTYPE", r"<html>", r"<body>"],
    "css": [r"[^{]+\s*\{[^}]*\}", r"@media", r"font-family:"],
}

SYMBOL_CLASS = "[α-ωΑ-Ω∑∫∂∇∞±≤≥≠≈∈∉⊂⊃∪∩∧∨¬→↔∀∃]"
DOLLAR_MATH = r"\$[^$]+\$"
CODE_HINT = r"def\s+\w+|function\s+\w+|class\s+\w+"

SYMBOL_NAMES = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon",
    "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa",
    "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi",
    "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi",
    "χ": "chi", "ψ": "psi", "ω": "omega",
    "∑": "sum", "∫": "integral", "∂": "partial", "∇": "nabla",
    "∞": "infinity", "±": "plus_minus", "≤": "less_equal", "≥": "greater_equal",
    "≠": "not_equal", "≈": "approximately", "∈": "element_of", "∉": "not_element_of",
    "⊂": "subset", "⊃": "superset", "∪": "union", "∩": "intersection",
    "∧": "and", "∨": "or", "¬": "not", "→": "implies", "↔": "if_and_only_if",
    "∀": "for_all", "∃": "exists",
}

# --- Fixed values: chunk scoring ---------------------------------------------

CHUNK_SIZE, CHUNK_OVERLAP, UNIT_WORDS = 500, 50, 200
SIMPLE_CHUNK, SIMPLE_OVERLAP = 400, 40

IMPORTANCE = {
    "high": ["definition", "theorem", "principle", "law", "algorithm", "formula", "proof", "concept"],
    "medium": ["example", "application", "method", "process", "procedure", "technique", "approach"],
    "low": ["note", "remark", "aside", "reference", "see also", "further reading"],
}
CHUNK_TYPE_WORDS = [
    ("definition", ["definition", "defined as", "is defined", "refers to"]),
    ("example", ["example", "for instance", "for example", "consider"]),
    ("procedure", ["step", "procedure", "method", "algorithm", "process"]),
]

# --- Fixed values: retrieval -------------------------------------------------

SYNONYMS = {
    "blockchain": ["distributed ledger", "cryptocurrency", "decentralized"],
    "consensus": ["agreement", "validation", "verification"],
    "smart contract": ["automated contract", "self-executing contract"],
    "mining": ["proof of work", "computation", "validation"],
    "token": ["cryptocurrency", "digital asset", "coin"],
    "node": ["participant", "peer", "network member"],
    "transaction": ["transfer", "exchange", "payment"],
    "security": ["cryptography", "protection", "safety"],
}
PROBES = [
    "fundamental concepts and definitions",
    "key principles and mechanisms",
    "practical applications and examples",
    "common problems and solutions",
    "important comparisons and differences",
    "technical processes and procedures",
    "theoretical foundations",
    "real-world implementations",
]
PROBE_FALLBACK = "blockchain technology and distributed systems"
CONTEXT_LIMIT, CONTEXT_RESERVE, CONTEXT_MIN_ROOM = 4000, 50, 100
MAX_CANDIDATES = 50

# --- Fixed values: question rules --------------------------------------------

BLOOM_WORDS = {
    "remember": ["define", "list", "name", "identify", "recall", "state"],
    "understand": ["explain", "describe", "summarize", "interpret", "classify"],
    "apply": ["use", "implement", "execute", "solve", "demonstrate"],
    "analyze": ["compare", "contrast", "distinguish", "examine", "categorize"],
    "evaluate": ["judge", "critique", "assess", "justify", "defend"],
    "create": ["design", "construct", "develop", "formulate", "combine"],
}
BLOOM_FALLBACK = [
    ("remember", ["what is", "define", "identify"]),
    ("understand", ["how", "why", "explain"]),
    ("analyze", ["compare", "difference"]),
]
AMBIGUOUS_WORDS = ["some", "many", "often", "usually", "might", "could"]
DOMAIN_CONCEPTS = [
    "blockchain", "bitcoin", "ethereum", "smart contract", "consensus",
    "mining", "proof of work", "proof of stake", "hash", "merkle tree",
    "wallet", "private key", "public key", "transaction", "block",
    "decentralized", "distributed", "immutable", "cryptography",
]
READABILITY_BANDS = [
    (90, "very_easy"), (80, "easy"), (70, "fairly_easy"), (60, "standard"),
    (50, "fairly_difficult"), (30, "difficult"),
]
READABILITY_LAST = "very_difficult"
GRADE_BANDS = [
    (0.9, "A+"), (0.85, "A"), (0.8, "A-"), (0.75, "B+"), (0.7, "B"),
    (0.65, "B-"), (0.6, "C+"), (0.55, "C"), (0.5, "C-"),
]
GRADE_LAST = "D"
HIGH_GRADES = ["A+", "A", "A-", "B+"]
SCORE_WEIGHTS = {
    "readability": 0.15, "distractor": 0.30, "cognitive": 0.20,
    "clarity": 0.25, "language": 0.10,
}

GATE_PLACEHOLDERS = [
    "option a", "option b", "option c", "option d", "placeholder",
    "additional choice", "choice needed", "add option", "another option",
]
GATE_NEGATIVES = ["not", "n't", "never", "except", "excluding"]
STRICT_PLACEHOLDERS = [
    "option a", "option b", "option c", "option d", "placeholder", "additional choice",
]
REPORT_PLACEHOLDERS = [
    "placeholder", "option a", "option b", "option c", "option d", "xxx", "...",
]
PLACEHOLDER_PATTERNS = [
    r"\b(option\s+[abcd])\b",
    r"\b(choice\s+[abcd])\b",
    r"\[.*?\]",
    r"\{.*?\}",
    r"xxx+",
    r"\.\.\.+",
    r"placeholder",
    r"insert\s+text",
    r"answer\s+here",
]
#: What stands in lower case wherever the pattern of the same place matches.
PLACEHOLDER_SIGNS = ["option", "choice", "[", "{", "xxx", "...", "placeholder", "insert", "answer"]
QUESTION_WORDS_MIN, QUESTION_WORDS_MAX = 5, 50
OPTION_WORDS_MIN, OPTION_WORDS_MAX = 3, 30

PERSPECTIVES = [
    "definitional", "comparative", "application",
    "problem-solving", "conceptual", "analytical",
]
PERSPECTIVE_BLOOM = {
    "definitional": "remember", "comparative": "understand", "application": "apply",
    "problem-solving": "analyze", "conceptual": "understand", "analytical": "analyze",
}
PERSPECTIVE_TYPES = {
    "definitional": ["factual", "conceptual"],
    "procedural": ["application", "troubleshooting"],
    "comparative": ["comparative", "analytical"],
    "application": ["application", "troubleshooting"],
    "analytical": ["analytical", "conceptual"],
    "conceptual": ["conceptual", "factual"],
    "problem-solving": ["troubleshooting", "application"],
}
PERSPECTIVE_TYPES_DEFAULT = ["factual", "conceptual", "application", "analytical"]

UI_CONCEPTS = [
    "blockchain", "consensus", "cryptocurrency", "mining", "hash",
    "block", "transaction", "distributed", "decentralized",
]
IDEAL_DIFFICULTY = {"EASY": 0.3, "MEDIUM": 0.5, "HARD": 0.2}

# --- Fixed values: message texts ---------------------------------------------

DISTRACTOR_ISSUES = {
    "few": "Insufficient number of distractors",
    "weak": "Not enough strong distractors (closeness >= 6)",
    "flat": "Distractors have similar closeness scores",
    "same": "All distractors use same misconception type",
    "none": "No distractors found",
}
CLARITY_ISSUES = {
    "negative": "Negative questions can be confusing",
    "marks": "Question should have exactly one question mark",
    "short": "Question may be too short/vague",
    "long": "Question may be too long/complex",
    "ambiguous": "Contains ambiguous words: ",
    "unbalanced": "Option lengths are unbalanced",
}
LANGUAGE_ISSUES = {
    "capital": "Question should start with capital letter",
    "end": "Question should end with question mark",
    "spaces": "Contains double spaces",
    "brackets": "Contains placeholder brackets",
    "repeat": "Contains repeated words",
}
QUESTION_ADVICE = {
    "readability": "Simplify language for better readability",
    "strong": "Add more plausible distractors (closeness score 6+)",
    "diverse": "Use different misconception types for distractors",
    "clarity": "Improve question clarity by addressing: ",
    "level": "Consider raising cognitive level beyond basic recall",
    "grammar": "Fix grammar and formatting issues",
}
ASSESSMENT_ADVICE = {
    "low": ("Improve ", " low-quality questions"),
    "easy": "Add more challenging questions",
    "hard": "Add more easier questions for better balance",
    "levels": "Increase cognitive level diversity",
    "issue": "Address common issue: ",
}
SYSTEM_ADVICE = {
    "success": "Consider reducing batch size to improve success rate",
    "time": "Generation time is high - consider optimizing prompts",
    "quality": "Overall question quality is low - review generation parameters",
}
CACHE_ADVICE = {
    "hits": "Consider increasing cache TTL or improving content similarity detection",
    "size": "Cache size is large - consider running cleanup",
}
RETRY_HINTS = [
    ("placeholder", [
        "- Write complete, meaningful text for ALL options",
        "- Never use 'Option A', 'Choice B', or similar placeholders",
    ]),
    ("length", [
        "- Keep each option between 5-25 words",
        "- Make options similar in length and detail",
    ]),
    ("distractor", [
        "- Create plausible wrong answers that students might choose",
        "- Base distractors on common misconceptions",
    ]),
]
RETRY_DEFAULT = "- Focus on creating high-quality, complete questions"
BASIC_ADVICE = "Install analytics dependencies for detailed analysis"
OPTION_DEFAULTS = {
    "why_correct": "This is the correct answer.",
    "key_points": "Correct understanding of the concept",
    "misconception": "Common Misconception",
    "why_wrong": "This represents a misunderstanding of the core concept.",
    "example": "This principle applies in practical scenarios.",
    "connects": "Related concepts and applications",
    "why_chosen": "Students often select this due to {type}.",
    "why_chosen_type": "surface-level understanding",
    "understanding": "The accurate understanding requires deeper knowledge.",
    "remember": "Remember the key principles of this concept.",
}

# --- Fixed values: misconception patterns -------------------------------------

CONCEPT_WORDS = {
    "consensus": ["consensus", "proof of work", "proof of stake", "mining", "validation"],
    "cryptography": ["hash", "encryption", "key", "signature", "cryptographic"],
    "smart_contracts": ["smart contract", "ethereum", "solidity", "dapp", "gas"],
    "mining": ["mining", "miner", "proof of work", "hash rate", "block reward"],
    "wallets": ["wallet", "private key", "public key", "address", "seed"],
    "transactions": ["transaction", "transfer", "input", "output", "utxo"],
    "decentralization": ["decentralized", "distributed", "peer-to-peer", "node"],
    "security": ["security", "attack", "vulnerability", "immutable", "tamper"],
}
# the tagging list has one more cryptography word than the applicability list
TAG_WORDS = {**CONCEPT_WORDS, "cryptography": CONCEPT_WORDS["cryptography"] + ["merkle"]}

# name, difficulties, closeness range, concepts
PATTERNS = [
    ("wallet_vs_node", ["easy", "medium"], (5, 7), ["wallets", "decentralization"]),
    ("mining_vs_validating", ["easy", "medium"], (6, 8), ["mining", "consensus"]),
    ("public_vs_private_key", ["easy", "medium"], (5, 7), ["cryptography", "wallets"]),
    ("hash_vs_encryption", ["medium", "hard"], (6, 8), ["cryptography"]),
    ("blockchain_as_database", ["easy", "medium"], (5, 7), ["decentralization"]),
    ("decentralization_equals_speed", ["medium", "hard"], (6, 8), ["decentralization", "consensus"]),
    ("consensus_is_voting", ["medium", "hard"], (6, 8), ["consensus"]),
    ("immutable_means_unhackable", ["hard"], (7, 9), ["security"]),
    ("pow_vs_pos", ["medium", "hard"], (7, 9), ["consensus", "mining"]),
    ("gas_fees_purpose", ["medium", "hard"], (6, 8), ["smart_contracts", "transactions"]),
    ("smart_contract_capabilities", ["hard"], (7, 8), ["smart_contracts"]),
    ("merkle_tree_purpose", ["hard"], (6, 8), ["cryptography"]),
]
DISTRACTOR_TERMS = [
    "blockchain", "bitcoin", "crypto", "hash", "key", "transaction",
    "block", "mining", "wallet", "consensus", "node", "contract",
]
HASH_SWAPS = [
    ("one-way", "two-way"), ("irreversible", "reversible"),
    ("cannot be reversed", "can be decrypted"), ("hash function", "encryption algorithm"),
]
DATABASE_SWAPS = [
    ("distributed", "centralized"), ("decentralized", "traditional"),
    ("immutable", "updateable"), ("consensus", "administrator approval"),
    ("peer-to-peer", "client-server"),
]
VOTING_SWAPS = [
    ("consensus mechanism", "voting system"), ("proof of work", "majority vote"),
    ("proof of stake", "stakeholder vote"), ("protocol", "poll"),
    ("algorithm", "ballot counting"),
]
STAKE_SWAPS = [
    ("computational power", "token holdings"), ("mining difficulty", "stake amount"),
    ("energy consumption", "token lock-up"), ("hash rate", "stake weight"),
]
GAS_SWAPS = [
    ("computational resources", "transaction fees"), ("execution cost", "network fee"),
    ("prevents infinite loops", "rewards miners"), ("limits computation", "covers bandwidth"),
]
MERKLE_PURPOSES = [
    "stores user passwords securely", "manages transaction ordering",
    "enables faster mining", "provides data compression",
]
SPEED_CLAUSE = " making transactions much faster"
UNHACKABLE_CLAUSE = ", making it completely secure from all attacks"
API_CLAUSE = " and can directly access any internet API"

# --- Fixed values: fallback question templates ---------------------------------

FALLBACK_MISCONCEPTION = "fallback_misconception"
FALLBACK_REASON = "Common misconception addressed by fallback question"
FALLBACK_EXPLANATION = "This tests understanding of "
FALLBACK_TEMPLATES = [
    (
        "What is the primary purpose of blockchain consensus mechanisms?",
        "To ensure all network participants agree on the current state of the ledger",
        [
            "To encrypt all transaction data for security",
            "To determine the price of cryptocurrency tokens",
            "To validate user identities on the network",
        ],
        "consensus mechanisms",
    ),
    (
        "What distinguishes a public blockchain from a private blockchain?",
        "Public blockchains are open to anyone, while private blockchains restrict access",
        [
            "Public blockchains are faster than private blockchains",
            "Private blockchains use different cryptographic algorithms",
            "Public blockchains cannot handle smart contracts",
        ],
        "blockchain types",
    ),
    (
        "What is the role of miners in a proof-of-work blockchain?",
        "To validate transactions and add new blocks by solving computational puzzles",
        [
            "To create new cryptocurrency tokens for distribution",
            "To manage user accounts and permissions",
            "To determine transaction fees for the network",
        ],
        "mining and proof-of-work",
    ),
]

# --- Fixed values: limits, time-to-live, estimates ------------------------------

RATE_LIMITS = {"embeddings": (60, 3000), "completions": (20, 500)}
TTL_MINUTES = {"questions": 7 * 1440, "embeddings": 30 * 1440, "documents": 14 * 1440, "queries": 30}
MAX_FILE_BYTES = 10 * 1024 * 1024
STAGE_WEIGHTS = {
    "upload": 0.05, "text_extraction": 0.20, "chunking": 0.15,
    "embedding_generation": 0.35, "vector_storage": 0.10, "question_generation": 0.15,
}
STAGE_MESSAGES = {
    "upload": ["📤 Uploading your PDF...", "📤 Processing uploaded file...", "📤 Upload complete!"],
    "text_extraction": ["📖 Reading PDF content...", "📖 Extracting text from pages...", "📖 Text extraction complete!"],
    "chunking": ["✂️ Breaking down content into sections...", "✂️ Creating manageable chunks...", "✂️ Content chunking complete!"],
    "embedding_generation": ["🧠 Analyzing content with AI...", "🧠 Creating semantic embeddings...", "🧠 AI analysis complete!"],
    "vector_storage": ["💾 Storing content in database...", "💾 Indexing for fast retrieval...", "💾 Storage complete!"],
    "question_generation": ["❓ Generating assessment questions...", "❓ Creating answer choices...", "❓ Questions generated successfully!"],
}
STAGE_MESSAGE_DEFAULT = ["Processing...", "Working...", "Complete!"]

FILE_MESSAGES = {
    "empty": "File is empty",
    "type": "Invalid file type",
    "pages": "File has no pages",
    "text": "File appears to contain no readable text",
    "little": "File has very little text content",
}

# --- Fixed values: English stop words, as shipped with pyspark.ml.feature.StopWordsRemover

STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which
who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()

# --- Fixed values: validation message formats -------------------------------------
# severity, issue type, description, suggestion

VALIDATION = {
    "missing_field": ("critical", "missing_field", "Missing required field: {field}", "Add {field} to question structure"),
    "position": ("major", "invalid_position", "Invalid correct_position: {value}", "Use A, B, C, or D for correct_position"),
    "difficulty": ("minor", "invalid_difficulty", "Invalid difficulty: {value}", "Use easy, medium, or hard for difficulty"),
    "empty": ("critical", "empty_field", "{field} is empty", "Provide content for {field}"),
    "placeholder": ("critical", "placeholder", "{field} contains placeholder text: {text}...", "Replace placeholder with actual content"),
    "short": ("major", "too_short", "{field} too short: {n} words (min: {limit})", "Expand {field} to at least {limit} words"),
    "long": ("minor", "too_long", "{field} too long: {n} words (max: {limit})", "Shorten {field} to under {limit} words"),
    "question_mark": ("minor", "formatting", "{field} ends with question mark (should be statement)", "Remove question mark from answer option"),
    "missing_option": ("critical", "missing_option", "Missing option {key}", "Add option {key} to question"),
    "unbalanced": ("minor", "unbalanced_options", "Option {key} length varies significantly from others", "Balance option lengths for better question quality"),
    "duplicate": ("major", "duplicate", "Duplicate question text (same as question {n})", "Generate unique question content"),
}
REPORT_GRADES = [(90, "🏆 EXCELLENT"), (80, "✅ GOOD"), (70, "⚠️  FAIR"), (60, "❌ POOR")]
REPORT_GRADE_LAST = "💥 CRITICAL"
REPORT_ADVICE = [
    ("critical_issues", "   1. Fix all critical issues immediately - these prevent proper functionality"),
    ("major_issues", "   2. Address major issues - these significantly impact quality"),
    ("bias_detected", "   3. Randomize correct answer positions more effectively"),
    ("duplicate_questions", "   4. Ensure all questions are unique"),
]
REPORT_TITLE = "QUESTION QUALITY VALIDATION REPORT"
REPORT_LAST = "For help fixing these issues, refer to the manual testing guide."

# --- Fixed values: generated responses ---------------------------------------------

RESPONSE_DEFAULTS = {
    "concept": "unknown",
    "misconception": "General Misconception",
    "why_wrong": "Common error in {perspective} understanding",
    "explanation": "This {perspective} question tests understanding of {concept}",
}

# --- Fixed values: export formats -----------------------------------------------------

EXPORT_FORMAT, EXPORT_VERSION = "assessment_json", "1.0"
CANVAS_HEADER = [
    "Title", "Question Text", "Question Type", "Points Possible", "Correct Comments",
    "Incorrect Comments", "Neutral Comments",
    "Answer 1", "Answer 1 Comment", "Answer 1 Weight", "Answer 2", "Answer 2 Comment", "Answer 2 Weight",
    "Answer 3", "Answer 3 Comment", "Answer 3 Weight", "Answer 4", "Answer 4 Comment", "Answer 4 Weight",
]
CANVAS_INCORRECT = "Please review the material and try again."
FORMS_HEADER = ["Question", "Option A", "Option B", "Option C", "Option D", "Correct Answer", "Explanation"]
NO_EXPLANATION = "No explanation provided"
