"""Fixed values the text operators match against.

These are data, not logic: each operator takes them as parameters and these
are the defaults.  They are listed plainly, in their natural order, because
results (classes, extracted terms, cleaned answers, scores) depend on them
exactly — order matters where a first match wins.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# Question classes, tried in this order; the first class with a pattern that
# is a substring of the lower-cased question wins, otherwise "general".
QUERY_PATTERNS: dict[str, list[str]] = {
    "product_lookup": ["find", "search", "looking for", "need", "want", "available", "in stock", "do you have"],
    "product_info": ["tell me about", "information about", "details about", "specs", "features"],
    "comparison": ["vs", "versus", "compare", "difference between", "better than", "which is better"],
    "availability": ["available", "in stock", "do you have", "can I get", "is there"],
    "pricing": ["price", "cost", "how much", "expensive", "cheap", "affordable"],
    "how_to": ["how to", "how do", "how can", "what is the process", "steps to", "guide"],
    "definition": ["what is", "define", "meaning of", "explain", "description"],
    "best_practices": ["best practices", "recommendations", "tips", "advice", "suggestions"],
    "metrics": ["kpi", "metrics", "measure", "track", "analyze", "performance"],
    "trends": ["trends", "future", "emerging", "latest", "new", "upcoming"],
    "support": ["help", "problem", "issue", "trouble", "support", "assistance"],
    "location": ["where", "location", "store", "branch", "address", "find store"],
}

# Domain terms: head -> synonyms.  A head is extracted when it, or any of its
# synonyms, is a substring of the lower-cased question.
DOMAIN_SYNONYMS: dict[str, list[str]] = {
    "customer": ["client", "consumer", "buyer", "shopper", "patron", "user", "clientele"],
    "sales": ["revenue", "turnover", "income", "earnings", "proceeds", "transactions"],
    "inventory": ["stock", "merchandise", "goods", "products", "items", "catalog", "assortment"],
    "store": ["shop", "outlet", "branch", "location", "retail space", "establishment"],
    "profit": ["margin", "earnings", "returns", "gains", "income", "profitability"],
    "marketing": ["promotion", "advertising", "branding", "campaigns", "outreach"],
    "supply chain": ["logistics", "distribution", "procurement", "sourcing", "fulfillment"],
    "e-commerce": ["online retail", "digital commerce", "web store", "online shopping"],
    "omnichannel": ["multichannel", "cross-channel", "integrated retail"],
    "product": ["item", "merchandise", "goods", "article", "commodity"],
    "price": ["cost", "pricing", "rate", "fee", "charge", "value"],
    "discount": ["sale", "offer", "deal", "promotion", "reduction"],
    "available": ["in stock", "available", "on hand", "ready", "accessible"],
    "quality": ["grade", "standard", "level", "caliber", "excellence"],
    "brand": ["label", "trademark", "name", "make", "manufacturer"],
    "category": ["type", "class", "group", "section", "department"],
    "size": ["dimension", "measurement", "scale", "fit"],
    "color": ["shade", "hue", "tone", "tint"],
    "material": ["fabric", "substance", "composition", "texture"],
}

# Extra domain words extracted when they occur as substrings.
EXTRA_DOMAIN_WORDS = ["shop", "buy", "purchase", "order", "delivery", "return",
                      "exchange", "warranty", "guarantee", "service", "checkout"]

# Context hints per question class (other classes get none).
CONTEXT_HINTS: dict[str, list[str]] = {
    "how_to": ["process", "steps", "implementation", "strategy"],
    "comparison": ["advantages", "disadvantages", "features", "benefits"],
    "definition": ["concept", "meaning", "explanation", "overview"],
    "best_practices": ["recommendations", "guidelines", "tips", "success factors"],
    "metrics": ["measurement", "tracking", "analysis", "performance"],
    "trends": ["future", "innovation", "emerging", "development"],
}

# Domain keywords for question prefixing (E2): 7 in the first profile, 17 later.
DOMAIN_KEYWORDS_7 = ["retail", "store", "customer", "sales", "inventory", "merchandise", "shopping"]
DOMAIN_KEYWORDS_17 = ["retail", "store", "customer", "sales", "inventory", "merchandise",
                      "shopping", "commerce", "e-commerce", "omnichannel", "supply chain",
                      "consumer", "market", "brand", "product", "pricing", "promotion"]
DOMAIN_PREFIX = "In the context of retail business operations: "

# Session topics (H7): kept when in this list or longer than 4 characters.
TOPIC_TERMS = ["retail", "customer", "sales", "inventory", "store", "marketing", "profit"]

# Answer validation word lists.
SPECIFIC_WORDS = ["specifically", "precisely", "exactly"]
UNCERTAIN_WORDS = ["might", "possibly", "perhaps", "unclear", "uncertain"]
STRUCTURE_MARKS = [":", "1.", "•", "first", "second"]
CONNECTORS = ["however", "therefore", "additionally", "furthermore"]
ISSUE_LABELS = ["Low confidence", "Low relevance", "Incomplete response", "Unclear response"]

# Answer cleaning, per profile.
PREFIXES_FAST = ["answer:", "response:", "assistant:"]
PREFIXES_IMPROVED = ["answer:", "response:", "bot:", "assistant:"]
PREFIXES_FLAN = ["answer:", "response:", "bot:", "assistant:", "context:", "question:",
                 "human:", "ai:", "based on the context", "according to the documents"]
PREFIXES_ORCA = ["answer:", "response:", "bot:", "assistant:", "context:", "question:",
                 "human:", "ai:", "professional retail analysis:", "detailed answer:",
                 "analysis:", "retail consultant:"]
PREFIXES_ADVANCED = PREFIXES_ORCA + ["based on the", "according to"]

REMOVE_PHRASES_FLAN = ["based on the retail documents", "according to the context provided",
                       "from the retail sector information"]

SKIP_LINES_FLAN = ["context:", "source:", "document:", "file:"]
SKIP_LINES_ORCA = ["context:", "source:", "document:", "file:", "based on the",
                   "according to the document", "the context shows", "from the provided"]
SKIP_LINES_ADVANCED = ["context:", "source:", "document:", "file:", "based on the document",
                       "according to the document", "the context shows", "from the provided",
                       "[debug]", "processing"]

OPENER_CHECKS = ["here's", "great", "based on", "from what", "in the"]
OPENERS = ["Here's what I found about that:", "Great question! Let me help you with that.",
           "Based on retail industry knowledge:", "From what I understand about retail:",
           "In the retail context:", ""]

EMPTY_MSG = {
    "fast": "I don't have enough information to answer that question.",
    "flan": "I don't have enough information in my retail knowledge base to answer that question accurately.",
    "orca": "I don't have sufficient information in my retail knowledge base to provide a comprehensive answer to your question.",
    "advanced": "I don't have sufficient information in my retail knowledge base to provide a comprehensive answer to your question.",
    "improved": "I don't have sufficient information to answer your question.",
}
NO_LINES_MSG = {
    "flan": "I don't have enough information in my retail knowledge base to provide a comprehensive answer to your question.",
    "orca": "I don't have enough relevant information in my retail knowledge base to provide a comprehensive answer to your specific question.",
    "advanced": "I don't have enough relevant information in my retail knowledge base to provide a comprehensive answer to your specific question.",
}
TRUNCATED_EMPTY_MSG = {
    "fast": "Please provide more specific details for an accurate answer.",
    "improved": "I don't have enough information to provide a comprehensive answer.",
}
APOLOGY = {
    "fast": "I apologize, but I couldn't process your request. Please try again.",
    "flan": "I apologize, but I encountered an issue processing your question. Please try rephrasing it.",
    "orca": "I apologize, but I encountered an issue processing your question. Please try rephrasing it or asking about a different aspect of retail operations.",
    "advanced": "I apologize, but I encountered an issue processing your question. Please try rephrasing it or asking about a different aspect of retail operations.",
    "improved": "I apologize, but I encountered an issue. Please try rephrasing your question.",
}
BLANK_REPLY = "Please ask a specific question."
# ------------------------------------------------------------ end fixed values
