"""Word lists, prompt texts and constants that decide the results.

They must stay as they are for scores to be comparable. Every function that uses one takes it as an
argument with the value here as the default.
"""

# --- text features ------------------------------------------------------------------------------

# Urgency terms, English then Turkish. The order decides which term wins at a position.
URGENCY_TERMS = [
    "now", "today", "limited", "hurry", "exclusive", "last chance",
    "deal", "promo", "discount", "must have",
    "şimdi", "hemen", "bugün", "sınırlı", "fırsat", "indirim", "acele",
    "kaçırma", "kaçırmayın", "son şans", "son gün", "stoklar tükeniyor",
    "son fırsat",
]

# Call-to-action phrases, English then Turkish.
CTA_PHRASES = [
    "buy now", "shop today", "grab yours", "order today", "get it now",
    "act fast", "join now", "sign up today", "start today", "try it now",
    "hemen al", "hemen satın al", "şimdi satın al", "hemen incele",
    "fırsatı kaçırmayın", "hemen sipariş ver", "sen de katıl", "hemen dene",
    "bugün keşfet",
]

# Code points counted as emoji.
EMOJI_CLASS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2764}\x{FE0F}]"

# --- sentiment and toxicity ---------------------------------------------------------------------

# English sentiment words.
POSITIVE_EN = [
    "amazing", "awesome", "best", "better", "brilliant", "excellent", "fantastic",
    "free", "great", "incredible", "love", "loved", "perfect", "win", "winning",
    "wins", "unlimited", "epic", "dream", "crazy", "excited", "happy", "beautiful",
    "smart", "intelligent", "seamless", "powerful", "battery", "future", "stunning",
    "helpful", "effective", "fun", "sleek", "premium", "value", "upgrade", "flawless",
]
NEGATIVE_EN = [
    "bad", "worst", "worse", "terrible", "awful", "hate", "horrible", "poor",
    "disappoint", "disappointed", "broken", "slow", "lag", "fragile", "outdated",
    "waste", "fail", "failed", "never", "cannot", "not", "no", "nothing",
    "annoying", "useless", "expensive", "overpriced", "regret", "quit",
]
NEGATORS_EN = ["not", "never", "no", "hardly", "barely"]

# Turkish sentiment words.
POSITIVE_TR = [
    "harika", "muhteşem", "süper", "mükemmel", "efsane", "benzersiz", "kusursuz",
    "ücretsiz", "fırsat", "indirim", "akıllı", "hızlı", "pratik", "yenilikçi",
    "seviyorum", "bayıldım", "sevdim", "güzel", "iyi", "sınırları aş", "şaşırtıcı",
    "kolay", "taşı", "öndeyim", "lider", "kazan", "coşkulu", "hesapsız",
]
NEGATIVE_TR = [
    "berbat", "kötü", "rezalet", "kırık", "yavaş", "beğenmedim", "pahalı",
    "iğrenç", "bozuk", "zaman kaybı", "pişman", "nefret", "vasat", "hayal kırıklığı",
    "çalışmıyor", "tükenmiş", "alma", "kandırmaca", "saçma", "geç", "karmaşık",
]
NEGATORS_TR = ["değil", "yok", "yoksa", "hiç"]

# Toxic terms; the Turkish ones count only in Turkish texts.
TOXIC_EN = [
    "stupid", "idiot", "dumb", "moron", "hate", "shut up", "loser", "trash",
    "garbage", "scam", "rip-off", "sucks", "pathetic", "delusional", "fraud",
]
TOXIC_TR = ["aptal", "salak", "dolandırıcı", "saçmalık", "rezalet", "mal", "gerizekalı"]

# What marks a text as Turkish, and the letters a Turkish word is made of.
TURKISH_LETTERS = "ğĞışİöÖüÜçÇ"
TURKISH_FUNCTION_WORDS = [
    "ve", "bir", "değil", "ile", "için", "çok", "ama", "var", "yok", "da", "de", "bile", "ya",
]
EXCLAMATION_BONUS = 0.1

# --- scoring ------------------------------------------------------------------------------------

# Benchmark scale, brand calibration, gate and weights.
BENCHMARK_REFERENCE = 35.0
BENCHMARK_FLOOR = 10.0
BENCHMARK_CEILING = 98.0
OFFBRAND_BASELINE = 0.30
BRAND_SCORE_FLOOR = 0.1
CTR_WEIGHT = 0.6
ALIGNMENT_THRESHOLD = 70
MAX_REWRITES = 2
PENALTY_PER_VIOLATION = 5

# The known engagement rule (intercept, weights, good length range, limits).
RULE_INTERCEPT = 1.6
RULE_WEIGHTS = {
    "urgency_count": 0.45,
    "sentiment_score": 0.50,
    "has_question": -0.40,
    "has_exclamation": 0.25,
    "has_cta": 0.45,
    "emoji_count": 0.30,
    "hashtag_count": 0.10,
    "has_mention": -0.20,
    "all_caps_ratio": 0.60,
    "word_diversity": 0.40,
    "numeric_ratio": 0.35,
    "toxicity_score": -2.00,
}
RULE_LENGTH_RANGE = (60, 150)
RULE_LENGTH_WEIGHT = -0.55
RULE_CTR_RANGE = (0.4, 60.0)
ENGAGEMENT_SHARES = {"likes_count": 0.55, "shares_count": 0.25, "comments_count": 0.20}
MIN_IMPRESSIONS = 100

# --- model columns ------------------------------------------------------------------------------

# Columns of the content model, of the full model, and of the ablation subsets.
CONTENT_COLUMNS = [
    "char_count", "word_count", "has_question", "has_exclamation",
    "urgency_count", "sentiment_score", "toxicity_score",
    "emoji_count", "hashtag_count", "has_hashtag", "has_mention", "has_cta",
    "avg_word_len", "word_diversity", "all_caps_ratio", "numeric_ratio",
]
CONTEXT_COLUMNS = ["log_impressions", "buzz_change_rate"]
FULL_COLUMNS = CONTENT_COLUMNS + CONTEXT_COLUMNS
STRUCTURAL_COLUMNS = [
    "char_count", "word_count", "emoji_count", "hashtag_count", "has_hashtag",
    "has_mention", "has_exclamation", "avg_word_len", "word_diversity",
    "all_caps_ratio", "numeric_ratio",
]
AFFECT_COLUMNS = ["sentiment_score", "toxicity_score"]
ACTION_COLUMNS = ["urgency_count", "has_cta", "has_question"]
ABLATION_SUBSETS = {
    "structural": STRUCTURAL_COLUMNS,
    "structural+sentiment/tox": STRUCTURAL_COLUMNS + AFFECT_COLUMNS,
    "structural+full (tam)": STRUCTURAL_COLUMNS + AFFECT_COLUMNS + ACTION_COLUMNS,
}
CORRELATION_COLUMNS = [
    "char_count", "word_count", "has_question", "has_exclamation", "urgency_count",
    "sentiment_score", "toxicity_score", "ctr_proxy",
]

# --- generation ---------------------------------------------------------------------------------

# Styles in order, with task and hint texts.
STYLES = ["emotional", "informative", "urgency", "humorous"]
STYLE_TASKS = {
    "emotional": "Write an emotional, heartfelt ad copy that connects with the reader on a personal level.",
    "informative": "Write an informative, fact-driven ad copy that highlights key product benefits clearly.",
    "urgency": "Write an urgent, action-driven ad copy that motivates immediate response.",
    "humorous": "Write a funny, witty ad copy that entertains while promoting the product.",
}
STYLE_HINTS = {
    "emotional": "of the brand's emotionally resonant lines",
    "informative": "of the brand's benefit-driven, feature-forward lines",
    "urgency": "of the brand's short, punchy, immediate lines",
    "humorous": "of the brand's playful, witty lines",
}
STYLE_LABELS = {
    "emotional": "Duygusal",
    "informative": "Bilgilendirici",
    "urgency": "Aciliyet vurgulu",
    "humorous": "Mizahi",
}

# System texts and never-write examples of the prompts.
GENERATION_SYSTEM = """You are an expert advertising copywriter. You write concise, compelling ad copy.
Rules:
- No fabricated price or discount claims.
- No false scarcity or misleading claims.
- No negative mentions of competitors.
- Keep each variant under 30 words.
- Never start with a generic teaser like 'Discover', 'Unleash', 'Elevate' or 'Say hello to'.
- Return ONLY the ad copy text, nothing else."""
NEVER_WRITE = [
    "Discover the amazing future of technology with our incredible new product!",
    "Unleash your potential with this must-have gadget, buy now!",
]
REWRITE_SYSTEM = """You are an expert advertising copywriter specializing in brand voice alignment.
You rewrite ad copy to match a specific brand's voice and style rules.
Rules:
- No fabricated price or discount claims.
- No false scarcity or misleading claims.
- No negative mentions of competitors.
- Keep each variant under 30 words.
- Return ONLY the rewritten ad copy text, nothing else."""

# Prompt templates. The names in braces are filled per row.
GENERATION_TEMPLATE = """{system}

Brand: {brand_name}
Tone: {tone_category}
Brand voice: {brand_voice_summary}

Style rules:
{style_rules}

Reference ad copies from this brand (tone examples, pick from these):
{references}

Examples of ad copy to NEVER write (generic, off-brand):
{never_write}

Product: {product}
Target audience: {audience}

Task: {style_task}

Write exactly ONE ad copy variant in the {style} style ({style_hint}). Stay true to the brand voice, sound like a real human, and avoid the never-write examples. Return ONLY the ad copy text."""
REWRITE_TEMPLATE = """{system}

Brand: {brand_name}
Tone: {tone_category}
Brand voice: {brand_voice_summary}

Style rules:
{style_rules}

Reference copies:
{references}

Original ad copy:
{text}

Current brand alignment score: {score}/100 (threshold: {threshold})
{violation_note}

Rewrite this ad copy to better match the brand voice. Keep the same message and approximate length.
Return ONLY the rewritten ad copy text."""
SEMANTIC_NOTE = "Semantic alignment is too low."
REFERENCES_IN_PROMPT = 5
REFERENCES_IN_REWRITE = 3

# Provider models in fallback order.
FALLBACK_MODELS = ["gemini-2.5-flash", "gemini-3.5-flash-lite", "gemini-3.5-flash"]

# Provider error classes in order of precedence: (class, substrings, message).
ERROR_CLASSES = [
    ("quota", ["resource_exhausted", "429"],
     "API günlük kotası doldu. Bi'r saat sonra veya yeni anahtar ile tekrar deneyin."),
    ("key", ["unauth", "api key", "invalid"],
     "API anahtarı geçersiz. .env dosyasındaki GOOGLE_API_KEY değerini kontrol edin."),
    ("service", ["503", "unavailable"],
     "Çığır açıcı servis geçici olarak kullanılamıyor; birkaç saniye sonra yeniden deneyin."),
    ("not_found", ["not found", "404"],
     "İstenen model bulunamadı. .env içindeki GEMINI_MODEL değerini kontrol edin."),
]
TRANSIENT_MARKS = ["429", "503", "rate", "unavailable"]
QUOTA_MARKS = ["resource_exhausted", "quota"]
REWRITE_QUOTA_MARKS = ["resource_exhausted", "quota", "429"]

# Defaults of a brand entry.
DEFAULT_TONE = "Genel"
DEFAULT_STYLE_RULES = ["Markanın ses tonuna sadık kal"]
