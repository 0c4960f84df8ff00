"""Word lists, patterns and constants that results depend on."""

# Keep as they are.
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
RERANK_THRESHOLD = 0.35
THRESHOLDS = {"book": 0.28, "tamil": 0.28, "web": 0.30}
RELAXED_BY = 0.08
PUBLISHERS = ["Tamil Nadu Textbook and Educational Services Corporation", "Samacheer Kalvi", "CBSE"]
EXCERPT_TAMIL, EXCERPT_FALLBACK = 1200, 800
LEAST_CHARACTERS = {"chunk": 40, "page": 40, "guide block": 30, "sentence": 10, "image side": 100}
TAMIL_CUES = ["என்பது", "எனப்படும்", "ஆகும்", "என்றால்", "குறிக்கும்", "விதி", "சூத்திரம்"]
PRIMARY_TYPES = ["textbook", "guide"]
MATH_SUBJECTS = ["math", "maths", "mathematics"]
MATH_WORDS = [
    "solve", "evaluate", "simplify", "ratio", "percentage", "fraction", "equation", "algebra", "geometry", "triangle", "circle", "rectangle", "square", "perimeter", "area", "volume",
    "mean", "median", "mode", "probability", "derivative", "integral", "matrix", "determinant", "vector", "number", "integer", "prime", "composite", "factor", "multiple", "lcm", "hcf",
    "gcd", "root", "power", "exponent", "theorem", "coordinate", "graph", "axis", "angle", "degree", "radius", "diameter", "trigonometry", "sine", "cosine", "tangent", "formula", "math",
    "maths", "mathematics", "addition", "subtraction", "multiplication", "division", "sum",
]
MATH_TAMIL = [
    r"மதிப்பு\s*காண்க", "தீர்வு", "சுருக்குக", "விகிதம்", "விழுக்காடு", "சதவீதம்", "பின்னம்", "சமன்பாடு", "இயற்கணிதம்", "வடிவியல்", "முக்கோணம்", "வட்டம்", "செவ்வகம்", "சதுரம்",
    "சுற்றளவு", "பரப்பளவு", "கனஅளவு", "சராசரி", "நிகழ்தகவு", "காரணி", "பெருக்கல்", r"மீ\.பொ\.வ", r"மீ\.பொ\.க", r"மீ\.சி\.ம", "கோணம்", "ஆரம்", "விட்டம்", "வரைபடம்", "கூட்டல்",
    "கழித்தல்", "வகுத்தல்", "எண்", "எண்கள்",
]
MATH_WHOLE = [r"\d+\s*x", r"x\s*[+\-]\s*y"]
MATH_SHAPES = [r"\d+[+\-*/÷=<>%^√]\d+", r"[x-z]\s*[+\-*/÷=<>%^√]", r"[+\-*/÷=<>%^√]\s*[x-z]"]
SCIENCE_WORDS = [
    "cell", "organ", "tissue", "plant", "animal", "species", "force", "gravity", "energy", "light", "sound", "heat", "temperature", "atom", "molecule", "element", "compound", "reaction",
    "acid", "base", "salt", "metal", "friction", "velocity", "acceleration", "mass", "weight", "density", "pressure", "electricity", "magnet", "circuit", "lens", "mirror", "reflection",
    "refraction", "spectrum", "fossil", "coal", "petroleum", "pollution", "environment", "ecosystem", "biodiversity", "photosynthesis", "respiration", "digestion", "circulation", "nervous",
    "disease", "virus", "bacteria", "fungi", "nutrient", "vitamin", "mineral", "hormone", "gene", "chromosome", "dna", "rna", "science", "physics", "chemistry", "biology",
]
SCIENCE_TAMIL = [
    "செல்", "திசு", "உறுப்பு", "தாவரம்", "விலங்கு", "விசை", "ஈர்ப்பு", "ஆற்றல்", "ஒளி", "ஒலி", "வெப்பம்", "வெப்பநிலை", "அணு", "மூலக்கூறு", "தனிமம்", "சேர்மம்", "வினை", "அமிலம்", "காரம்",
    "உப்பு", "உலோகம்", "அலோகம்", "உராய்வு", "திசைவேகம்", "முடுக்கம்", "நிறை", "எடை", "அடர்த்தி", "அழுத்தம்", "மின்சாரம்", "காந்தம்", "மின்சுற்று", "ஆடி", "பிரதிபலிப்பு", "விலகல்", "நிறமாலை",
    "மட்கும்", "சுற்றுச்சூழல்", "சுவாசம்", "செரிமானம்", "இரத்த ஓட்டம்", "நரம்பு", "நோய்", "வைரஸ்", "பாக்டீரியா", "ஊட்டச்சத்து", "வைட்டமின்", "அறிவியல்", "இயற்பியல்", "வேதியியல்", "உயிரியல்",
]
ASSESSMENT = ["quiz", "test", "practice", "exercise", "exam", "questions", "pyq", "தேர்வு", "பயிற்சி", "வினாடி வினா"]
ASSESSMENT_TYPES = ["previous_year", "teacher_notes", "firecrawl_education", "textbook", "guide"]
COPYRIGHT = ["first edition", "reprint", "published by", "copyright", "பதிப்பு", "உரிமம்", "வெளியீடு", "விலை", "அச்சிட்டோர்", "printed by", "isbn", "government of tamil nadu", "அரசு"]
PAGE_METADATA = ["government of tamil nadu", "அரசு", "first edition", r"\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2}", r".*\.indd", r".*\.ai", "http://.*"]
QR_CAPTION = ["qr code", "வளையப் படம்", "உரலி", "scan", "விரைவுக் குறியீடு"]
BLOCKED = ["violent", "kill", "naked", "porn", "weapon", "bomb", "hate"]
IMAGE_WORDS = ["வரைபடம்", "படம்", "diagram", "image", "picture", "draw"]
MORE_WORDS = [r"explain\s+more", r"tell\s+me\s+more", r"more\s+detail", "elaborate", r"give\s+more", r"show\s+more", "continue", r"go\s+on", "next", "இன்னும்", "மேலும்", "விரிவாக", "தொடர்", "மேல்"]
HARD = ["explain", "derive", "xylem", "transportation", "phloem", "photosynthesis process", "equation", "formula", "theorem", "law of", "difference between", "compare", "விளக்குக", "நெறிமுறை", "வேறுபடுத்துக", "சூத்திரம்", "விதி", "செயல்முறை"]
EASY = ["what is", "define", "who", "when", "where", "name the", "list", "என்ன", "வரையறு", "யார்", "எப்போது", "எங்கு", "பெயரிடுக"]
CONFUSED = ["i don't understand", "explain again", "confusing", "hard", "difficult", "simpler", "simplify", "teach again", "tell me again", "புரியவில்லை", "மீண்டும் சொல்லுங்கள்", "எளிமையாக", "மீண்டும் விளக்கு", "புரியல"]
EXAM = ["important questions", "2 marks", "3 marks", "5 marks", "board exam", "assessment", "test", "revision", "exam prep", "முக்கிய கேள்விகள்", "மதிப்பெண்", "தேர்வு", "திருப்புதல்"]
PRACTICE = ["quiz", "test", "practice", "exercise", "questions", "வினாடி வினா", "பயிற்சி"]
FOLLOW_UP = ["example", "why", "how", "another", "quiz", "practice", "translate"]
CHAPTER_WORDS = ["அலகு", "அத்தியாயம்", "அதிகாரம்", "unit", "chapter"]
ROLES = {
    "definition": ["வரையறை", "definition", "விதி", "law"],
    "example": ["எடுத்துக்காட்டு", "worked example", "தீர்க்கப்பட்ட கணக்கு", "தீர்வு"],
    "exercise": ["பயிற்சி", "exercise", "மதிப்பீடு", "evaluation", "கேள்வி-பதில்"],
    "activity": ["செயல்பாடு", "activity", "ஆராய்ந்து அறிக"],
}
CORRECTION_STOPS = ["is", "the", "of", "a", "an", "what", "how", "why", "to", "in", "it", "should", "be", "wrong", "and"]
RELEVANCE_STOPS = [
    "what", "is", "the", "a", "an", "of", "in", "and", "or", "to", "are", "how", "does", "do", "give", "explain", "define", "tell", "me", "about", "its", "their", "for", "with", "from",
    "by", "on", "at", "be", "was", "were", "has", "have", "had", "it",
]
CUES = ["is", "are", "called", "defined", "means", "refers", "classified", "types", "example", "examples"]
BANNED_PHRASES = ["இதை உங்கள் நெட்வொர்க்", "சேமிக்கவும்", "RIGHT COLUMN", "LEFT COLUMN"]
GLOSSARY_HEADERS = ["glossary", "சொல்லகராதி", "கலைச்சொற்கள்", "அகராதி"]
SCRIPTS = {"European": (0x0000, 0x007F), "Chinese (Basic)": (0x4E00, 0x9FFF), "Tamil": (0x0B80, 0x0BFF), "Hindi": (0x0900, 0x097F), "Telugu": (0x0C00, 0x0C7F), "Malayalam": (0x0D00, 0x0D7F), "Kannada": (0x0C80, 0x0CFF), "Marathi": (0x0900, 0x097F), "Bengali": (0x0980, 0x09FF)}
