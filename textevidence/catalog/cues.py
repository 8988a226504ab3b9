"""The cue catalog and the romanised-token list: values that the contract fixes, as text, in catalog order."""

from __future__ import annotations

# Fixed values: (phrase, dialect label, speaker region, candidate label, source); the position decides ties.
CUES: list[tuple[str, str, str, str, str]] = [
    ("আমি সিলেটি ভাষায় কথা কই", "sylhet", "Sylhet", "Sylhet", "phrase_chip"),
    ("তে খইনছাইন আফনের দিনখান, দিনখাল কিলাখান যায় তে? বালা যার, বাক্কা বালা যার, আফনার কিতা অবস্থা?", "sylhet", "Sylhet", "RegSpeech12 Sylhet sample", "sample_catalog"),
    ("আমি বরিশালে থাকি", "barishal", "Barishal", "Barishal", "phrase_chip"),
    ("আসসালামু আলাইকুম, আমার নাম হাসিবুর রহমান শুব, ডিপারমেন্ট অব সপটোওয়্যার ইনজিনারিং, ফাস্ট সেমিস্টার, ব্যাচ নাম্বার ফোরটি। আমি ড্যাফোডিল ইন্টারন্যাশনাল ইউনিবার্সিটিতে পড়াশুনা করতেছি। আর আমার হোম টাউন হচ্ছে হলো বরিশালে।", "barishal", "Barishal", "RegSpeech12 Barishal sample", "sample_catalog"),
    ("আমি চট্টগ্রামের মানুষ", "chittagong", "Chattogram", "Chattogram", "phrase_chip"),
    ("নোয়াখালীতে আইজ বৃষ্টি হইব", "noakhali", "Noakhali", "Noakhali custom", "phrase_chip"),
    ("অন কথা হচ্ছে আমরা তো ইয়ানে আড্ডাদি না বন্ধু। আমরা আড্ডাদি মেলা দূর একজাগাত। কোনাই? সুজাহুর, সুজাহুর তো তুই চিনতি ন। সুজাপুরের নাম শুনছিলাম মনে অয়। অনেক দূরে", "noakhali", "Noakhali", "RegSpeech12 Noakhali sample", "sample_catalog"),
    ("কী অবস্তা ভাইয়া, তুঁই গম আসো না? অ বালা আছি। তোঁয়ার বাড়ি খডে দে ভাইয়্যে? আঁর বাড়ি অইলদি কক্সবাজারর চকরিয়া। চকরিয়া খোন জাগাত ফইজ্জে দে তোঁয়ার বাড়ি ইবে? চকরিয়ার বড় মোহরি, হিন্দুফারা. বড় মোহরির মইদ্যে এহন তোঁয়ারার উইন্দি দি ছাত্রলীগর সভাপতি খন ?", "chittagong", "Chittagong", "RegSpeech12 Chittagong sample", "sample_catalog"),
    ("সুমন তারপর হইলো রানা, তারপর জসিম, জাকারিয়া এরা কয়েকঝনের নাম দিছলাম ওটে।", "rangpur", "Rangpur", "RegSpeech12 Rangpur sample", "sample_catalog"),
    ("আইচ্ছা। আমনেরা এনজিও সম্পর্কে কিছু জানেন নে? জানি। তো এনজিও, টাকা লই না, আইচ্ছা, হিয়াল্লাই জানি, আইচ্ছা।", "sandwip", "Sandwip", "RegSpeech12 Sandwip sample", "sample_catalog"),
    ("আমি ঢাকায় থাকি, এখানে অনেক মানুষ।", "dhaka", "Dhaka", "Dhaka standard", "phrase_chip"),
    ("আমি রাজশাহীর মানুষ, পদ্মার পাড়ে বাড়ি", "rajshahi", "Rajshahi", "Rajshahi", "phrase_chip"),
    ("হামার বাড়ি রাজশাহীতে, আমের বাগান আর পদ্মা নদীর পাড়ে থাকি", "rajshahi", "Rajshahi", "Rajshahi curated cue", "curated_cue"),
    ("আমি খুলনার মানুষ, রূপসা নদীর পাড়ে থাকি", "khulna", "Khulna", "Khulna", "phrase_chip"),
    ("কিরাম আছো? আমরা খুলনার রূপসা নদীর পাড়ে থাকি", "khulna", "Khulna", "Khulna curated cue", "curated_cue"),
    ("আমি ময়মনসিংহের মানুষ, ব্রহ্মপুত্রের পাড়ে বাড়ি", "mymensingh", "Mymensingh", "Mymensingh", "phrase_chip"),
    ("কেডা আইতাছে? আমরা ময়মনসিংহের মানুষ, পুরান ব্রহ্মপুত্রের পাড়ে থাকি", "mymensingh", "Mymensingh", "Mymensingh curated cue", "curated_cue"),
    ("আমি কুমিল্লার মানুষ, গোমতী নদীর পাড়ে থাকি", "cumilla", "Cumilla", "Cumilla", "phrase_chip"),
    ("কিতা করতাছো? আমরা কুমিল্লায় থাকি, ধর্মসাগরের কাছে বাড়ি", "cumilla", "Cumilla", "Cumilla curated cue", "curated_cue"),
]

# Bengali word and its Latin spellings.
ROMANISED: dict[str, str] = {
    "আমি": "ami",
    "আমরা": "amra",
    "আমার": "amar",
    "হামার": "hamar",
    "তুমি": "tumi",
    "তোমার": "tomar",
    "আপনি": "apni",
    "আফনে": "afne",
    "আফনার": "afnar afner",
    "কি": "ki",
    "কী": "kee",
    "কিতা": "kita",
    "কেডা": "keda",
    "কেন": "keno ken",
    "কোথায়": "kothay kuthay",
    "এখানে": "ekhane ehane",
    "সেখানে": "sekhane shekhane",
    "আজ": "aj aaj",
    "আইজ": "aij aiz",
    "কাল": "kal",
    "এখন": "ekhon ehon",
    "অনেক": "onek",
    "ভালা": "bala vala",
    "ভালো": "bhalo valo",
    "আছি": "achi asi",
    "আছো": "achho acho aso",
    "আছে": "achhe ase",
    "থাকি": "thaki",
    "করি": "kori",
    "করতাছো": "kortachho kortaso kortaco",
    "আইতাছে": "aitachhe aitase aitace",
    "যাইতাছে": "jaitachhe jaitase zaitase",
    "কথা": "kotha katha",
    "কই": "koi",
    "খবর": "khobor khabor",
    "কাজ": "kaj",
    "কাজকাম": "kajkam",
    "বাড়ি": "bari",
    "বাসায়": "basay",
    "টাকা": "taka",
    "মানুষ": "manush manus",
    "না": "na",
    "আর": "ar",
    "ভাষায়": "bhashay vashay bashay",
    "বৃষ্টি": "brishti bristi bisti",
    "হইব": "hoibo hoibe",
    "কাছে": "kachhe kase",
    "পুরান": "puran purano",
    "কিরাম": "kiram",
    "আমের": "amer",
    "বাগান": "bagan",
    "নদীর": "nodir",
    "পদ্মা": "podda padma",
    "পদ্মার": "poddar padmar",
    "পাড়ে": "pare",
    "রূপসা": "rupsa rupsha",
    "গোমতী": "gomti gomoti",
    "ব্রহ্মপুত্রের": "brahmaputrer",
    "ধর্মসাগরের": "dharmasagarer dhormosagorer",
    "সিলেটি": "sylheti sileti",
    "বরিশালে": "borishale barishale",
    "চট্টগ্রামের": "chattogramer chottogramer",
    "নোয়াখালীতে": "noakhalite",
    "ঢাকায়": "dhakay",
    "রাজশাহীর": "rajshahir",
    "রাজশাহীতে": "rajshahite",
    "খুলনার": "khulnar",
    "ময়মনসিংহের": "mymensingher moymonshingher mymensingh",
    "কুমিল্লার": "cumillar kumillar",
    "কুমিল্লায়": "cumillay kumillay",
}

# Labels whose cues are place phrases and need the higher floor.
CURATED_LABELS = ["rajshahi", "khulna", "mymensingh", "cumilla"]

# Dialect label and the region first listed for it among samples, then options.
REGIONS: dict[str, str] = {
    "sylhet": "Sylhet",
    "barishal": "Barishal",
    "chittagong": "Chattogram",
    "noakhali": "Noakhali",
    "rajshahi": "Rajshahi",
    "khulna": "Khulna",
    "mymensingh": "Mymensingh",
    "cumilla": "Cumilla",
    "rangpur": "Rangpur",
    "sandwip": "Sandwip",
    "dhaka": "Dhaka",
}

# Limits and floors of cue scoring.
MOST_CHARS, LONGEST_EDIT = 2000, 300
FLOOR, CURATED_FLOOR = 0.58, 0.75

VARIANTS: dict[str, str] = {latin: bengali for bengali, spellings in ROMANISED.items() for latin in spellings.split()}
