"""Word lists, patterns and tables that results depend on, stated as they must be."""

# Fixed values -----------------------------------------------------------------------------------------------------
PAGE_TYPES = ["metadata", "headnote", "facts", "issues", "arguments", "reasoning", "dissent", "order", "unknown"]
METADATA_MARKERS = ["PETITIONER", "RESPONDENT", "DATE OF JUDGMENT", "BENCH", "CITATION", "CITATOR INFO", "Equivalent citations", "Author:", "RF ", "E ", "R ", "MV ", "F "]
SECTION_MARKERS = {
    "headnote": ["HEADNOTE", "HEAD NOTE", "Held", "HELD", "holding"],
    "facts": ["FACTS", "FACTS OF THE CASE", "The facts", "factual background", "Brief facts", "Facts in brief", "factual matrix"],
    "issues": ["ISSUES", "ISSUES FOR CONSIDERATION", "The question", "questions for consideration", "Points for determination", "The issues", "The point for consideration"],
    "arguments": ["ARGUMENTS", "SUBMISSIONS", "Learned counsel", "It was argued", "It is contended", "It was submitted", "counsel for the appellant", "counsel for the respondent", "Shri", "Sri", "Mr."],
    "reasoning": ["JUDGMENT", "ORIGINAL JURISDICTION", "The judgment", "We have heard", "I have considered", "ANALYSIS", "We have carefully considered", "Having heard", "I have given my anxious consideration", "In my view"],
    "dissent": ["dissenting", "DISSENT", "DISSENTING OPINION", "I am unable to agree", "With respect, I disagree", "delivered a separate", "MINORITY VIEW"],
    "order": ["ORDER", "FINAL ORDER", "Appeal allowed", "Appeal dismissed", "Petition allowed", "Petition dismissed", "disposed of", "The appeal is", "writ petition is"],
}
FOOTER_PATTERNS = [r"Indian Kanoon\s*-\s*https?://indiankanoon\.org/doc/\d+/?\s*\d*", r"\n\s*\d{1,3}\s*$"]
#: (pattern, group that is the citation)
CITATION_PATTERNS = [
    (r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+v\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*\(\[?\d{4}\]?\s*[A-Z\.]+\s*\d+\)", 1),
    (r"\d{4}\s+AIR\s+\d+", 0),
    (r"\d{4}\s+SCR\s+\d+", 0),
    (r"\[\d{4}\]\s+[A-Z\.]+\s+\d+", 0),
    (r"[Ss]ection\s+\d+[A-Za-z]*(?:\s*\(\d+\)(?:\s*\([a-z]\))?)?", 0),
    (r"[Aa]rticle\s+\d+(?:\s*\(\d+\)(?:\s*\([a-z]\))?)?", 0),
    (r"(?:the\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+Act,?\s+\d{4}", 0),
]
ABBREVIATIONS = ["v", "vs", "no", "nos", "art", "sec", "hon", "shri", "smt", "mr", "mrs", "dr", "prof", "sr", "jr", "ltd", "pvt", "govt", "assn", "corp", "inc", "para", "paras", "cl", "sub", "i.e", "e.g", "viz", "ibid", "supra", "etc"]
SUMMARY_SECTIONS = ["headnote", "facts", "issues", "arguments", "reasoning", "order"]
SECTION_BOOSTS = [("order", 0.25), ("judgment", 0.20), ("reasoning", 0.10), ("facts", 0.05), ("issues", 0.03), ("headnote", 0.02)]
INTENTS = [
    ("facts", "What are the material facts and circumstances of this case?"),
    ("issues", "What are the legal issues and questions for consideration?"),
    ("arguments", "What arguments and submissions were made by the parties and their counsel?"),
    ("reasoning", "What is the court's legal analysis, reasoning, and interpretation?"),
    ("decision", "What is the final decision, order, and judgment of the court?"),
    ("temporal", "What are the key dates, timelines, and chronological events in this case?"),
    ("expert", "What expert witness testimony, medical opinions, or professional assessments were given?"),
    ("standard", "What is the standard of care, duty, or legal test applied by the court?"),
]
DRIFT_PATTERNS = [r"\bUnited States\b", r"\bU\.S\.\b", r"\bSecurities Exchange Act\b", r"\bRule\s*10b-5\b", r"\bCalifornia\b", r"\bNew York\b", r"\bFederal Court\b", r"\bSEBI\b", r"\bSecurities and Exchange Board of India\b", r"\bBombay High Court\b", r"\bCalcutta High Court\b", r"\bHigh Court of West Bengal\b"]
SECTION_MENTION = r"\b[Ss]ection\s+\d+[A-Za-z]*(?:\s*\(\d+\))?"
#: (value, name, emoji, model, top_n, max_length, min_length, description)
LEVELS = [
    (1, "Executive", "📋", "pegasus", 20, 350, 150, "Concise overview for decision-makers (~150 words)"),
    (2, "Detailed", "📄", "led", 35, 800, 360, "Comprehensive summary for lawyers (~400 words)"),
    (3, "Technical", "🔬", "led", 45, 1020, 500, "In-depth analysis for researchers (~600 words)"),
    (4, "Extractive", "📌", "none", 25, 0, 0, "Top-ranked sentences, no generation (~400 words)"),
]
WORD_LIMIT, WINDOW_WORDS, WINDOW_OVERLAP = 393, 400, 50  # 512 tokens at 1.3 a word
CHUNK_MAX, CHUNK_TARGET, CHUNK_MIN, CHUNK_OVERLAP = 500, 400, 300, 50
GLOBAL_WEIGHT, SECTION_WEIGHT, DIVERSITY, TAIL = 0.4, 0.6, 0.95, 3
# -----------------------------------------------------------------------------------------------------------------
