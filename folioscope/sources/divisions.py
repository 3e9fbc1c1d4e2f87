"""The divisions of the corpus and where its parts start: fixed values, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import page_file

# Number, name, its translation, where it was revealed, verses.
DIVISIONS = [
    (1, "Al-Faatiha", "The Opening", "Meccan", 7),
    (2, "Al-Baqara", "The Cow", "Medinan", 286),
    (3, "Aal-i-Imraan", "The Family of Imraan", "Medinan", 200),
    (4, "An-Nisaa", "The Women", "Medinan", 176),
    (5, "Al-Maaida", "The Table Spread", "Medinan", 120),
    (6, "Al-An'aam", "The Cattle", "Meccan", 165),
    (7, "Al-A'raaf", "The Heights", "Meccan", 206),
    (8, "Al-Anfaal", "The Spoils of War", "Medinan", 75),
    (9, "At-Tawba", "The Repentance", "Medinan", 129),
    (10, "Yunus", "Jonah", "Meccan", 109),
    (11, "Hud", "Hud", "Meccan", 123),
    (12, "Yusuf", "Joseph", "Meccan", 111),
    (13, "Ar-Ra'd", "The Thunder", "Medinan", 43),
    (14, "Ibrahim", "Abraham", "Meccan", 52),
    (15, "Al-Hijr", "The Rocky Tract", "Meccan", 99),
    (16, "An-Nahl", "The Bee", "Meccan", 128),
    (17, "Al-Israa", "The Night Journey", "Meccan", 111),
    (18, "Al-Kahf", "The Cave", "Meccan", 110),
    (19, "Maryam", "Mary", "Meccan", 98),
    (20, "Taa-Haa", "Taa-Haa", "Meccan", 135),
    (21, "Al-Anbiyaa", "The Prophets", "Meccan", 112),
    (22, "Al-Hajj", "The Pilgrimage", "Medinan", 78),
    (23, "Al-Muminoon", "The Believers", "Meccan", 118),
    (24, "An-Noor", "The Light", "Medinan", 64),
    (25, "Al-Furqaan", "The Criterion", "Meccan", 77),
    (26, "Ash-Shu'araa", "The Poets", "Meccan", 227),
    (27, "An-Naml", "The Ant", "Meccan", 93),
    (28, "Al-Qasas", "The Stories", "Meccan", 88),
    (29, "Al-Ankaboot", "The Spider", "Meccan", 69),
    (30, "Ar-Room", "The Romans", "Meccan", 60),
    (31, "Luqman", "Luqman", "Meccan", 34),
    (32, "As-Sajda", "The Prostration", "Meccan", 30),
    (33, "Al-Ahzaab", "The Clans", "Medinan", 73),
    (34, "Saba", "Sheba", "Meccan", 54),
    (35, "Faatir", "The Originator", "Meccan", 45),
    (36, "Yaseen", "Yaseen", "Meccan", 83),
    (37, "As-Saaffaat", "Those drawn up in Ranks", "Meccan", 182),
    (38, "Saad", "The Letter Saad", "Meccan", 88),
    (39, "Az-Zumar", "The Groups", "Meccan", 75),
    (40, "Ghaafir", "The Forgiver", "Meccan", 85),
    (41, "Fussilat", "Explained in Detail", "Meccan", 54),
    (42, "Ash-Shooraa", "Consultation", "Meccan", 53),
    (43, "Az-Zukhruf", "Ornaments of Gold", "Meccan", 89),
    (44, "Ad-Dukhaan", "The Smoke", "Meccan", 59),
    (45, "Al-Jaathiya", "Crouching", "Meccan", 37),
    (46, "Al-Ahqaaf", "The Dunes", "Meccan", 35),
    (47, "Muhammad", "Muhammad", "Medinan", 38),
    (48, "Al-Fath", "The Victory", "Medinan", 29),
    (49, "Al-Hujuraat", "The Inner Apartments", "Medinan", 18),
    (50, "Qaaf", "The Letter Qaaf", "Meccan", 45),
    (51, "Adh-Dhaariyat", "The Winnowing Winds", "Meccan", 60),
    (52, "At-Toor", "The Mount", "Meccan", 49),
    (53, "An-Najm", "The Star", "Meccan", 62),
    (54, "Al-Qamar", "The Moon", "Meccan", 55),
    (55, "Ar-Rahmaan", "The Beneficent", "Medinan", 78),
    (56, "Al-Waaqia", "The Inevitable", "Meccan", 96),
    (57, "Al-Hadeed", "The Iron", "Medinan", 29),
    (58, "Al-Mujaadila", "The Pleading Woman", "Medinan", 22),
    (59, "Al-Hashr", "The Exile", "Medinan", 24),
    (60, "Al-Mumtahana", "She That is to be Examined", "Medinan", 13),
    (61, "As-Saff", "The Ranks", "Medinan", 14),
    (62, "Al-Jumu'a", "Friday", "Medinan", 11),
    (63, "Al-Munaafiqoon", "The Hypocrites", "Medinan", 11),
    (64, "At-Taghaabun", "Mutual Disillusion", "Medinan", 18),
    (65, "At-Talaaq", "The Divorce", "Medinan", 12),
    (66, "At-Tahreem", "The Prohibition", "Medinan", 12),
    (67, "Al-Mulk", "The Sovereignty", "Meccan", 30),
    (68, "Al-Qalam", "The Pen", "Meccan", 52),
    (69, "Al-Haaqqa", "The Reality", "Meccan", 52),
    (70, "Al-Ma'aarij", "The Ascending Stairways", "Meccan", 44),
    (71, "Nooh", "Noah", "Meccan", 28),
    (72, "Al-Jinn", "The Jinn", "Meccan", 28),
    (73, "Al-Muzzammil", "The Enshrouded One", "Meccan", 20),
    (74, "Al-Muddaththir", "The Cloaked One", "Meccan", 56),
    (75, "Al-Qiyaama", "The Resurrection", "Meccan", 40),
    (76, "Al-Insaan", "Man", "Medinan", 31),
    (77, "Al-Mursalaat", "The Emissaries", "Meccan", 50),
    (78, "An-Naba", "The Announcement", "Meccan", 40),
    (79, "An-Naazi'aat", "Those who Drag Forth", "Meccan", 46),
    (80, "Abasa", "He Frowned", "Meccan", 42),
    (81, "At-Takweer", "The Overthrowing", "Meccan", 29),
    (82, "Al-Infitaar", "The Cleaving", "Meccan", 19),
    (83, "Al-Mutaffifeen", "Defrauding", "Meccan", 36),
    (84, "Al-Inshiqaaq", "The Splitting Open", "Meccan", 25),
    (85, "Al-Burooj", "The Constellations", "Meccan", 22),
    (86, "At-Taariq", "The Morning Star", "Meccan", 17),
    (87, "Al-A'laa", "The Most High", "Meccan", 19),
    (88, "Al-Ghaashiya", "The Overwhelming", "Meccan", 26),
    (89, "Al-Fajr", "The Dawn", "Meccan", 30),
    (90, "Al-Balad", "The City", "Meccan", 20),
    (91, "Ash-Shams", "The Sun", "Meccan", 15),
    (92, "Al-Lail", "The Night", "Meccan", 21),
    (93, "Ad-Dhuhaa", "The Morning Hours", "Meccan", 11),
    (94, "Ash-Sharh", "The Consolation", "Meccan", 8),
    (95, "At-Teen", "The Fig", "Meccan", 8),
    (96, "Al-Alaq", "The Clot", "Meccan", 19),
    (97, "Al-Qadr", "The Power, Fate", "Meccan", 5),
    (98, "Al-Bayyina", "The Evidence", "Medinan", 8),
    (99, "Az-Zalzala", "The Earthquake", "Medinan", 8),
    (100, "Al-Aadiyaat", "The Courser", "Meccan", 11),
    (101, "Al-Qaari'a", "The Calamity", "Meccan", 11),
    (102, "At-Takaathur", "Competition", "Meccan", 8),
    (103, "Al-Asr", "The Declining Day", "Meccan", 3),
    (104, "Al-Humaza", "The Traducer", "Meccan", 9),
    (105, "Al-Feel", "The Elephant", "Meccan", 5),
    (106, "Quraish", "Quraish", "Meccan", 4),
    (107, "Al-Maa'oon", "Small Kindnesses", "Meccan", 7),
    (108, "Al-Kawthar", "Abundance", "Meccan", 3),
    (109, "Al-Kaafiroon", "The Disbelievers", "Meccan", 6),
    (110, "An-Nasr", "Divine Support", "Medinan", 3),
    (111, "Al-Masad", "The Palm Fibre", "Meccan", 5),
    (112, "Al-Ikhlaas", "Sincerity", "Meccan", 4),
    (113, "Al-Falaq", "The Dawn", "Meccan", 5),
    (114, "An-Naas", "Mankind", "Meccan", 6),
]

# Division and verse at which each part starts, the first part first.
PART_STARTS = [
    (1, 1), (2, 142), (2, 253), (3, 93), (4, 24), (4, 148), (5, 82), (6, 111), (7, 88), (8, 41),
    (9, 93), (10, 1), (11, 6), (12, 53), (13, 1), (14, 1), (15, 1), (16, 128), (17, 1), (18, 1),
    (19, 1), (20, 1), (21, 1), (22, 1), (23, 1), (24, 1), (25, 1), (26, 1), (27, 1), (27, 57),
    (29, 1), (30, 1), (31, 1), (32, 1), (33, 1), (34, 1), (35, 1), (36, 1), (37, 1), (38, 1),
    (39, 1), (40, 1), (41, 1), (42, 1), (43, 1), (44, 1), (45, 1), (46, 1), (47, 1), (48, 1),
    (49, 1), (50, 1), (51, 1), (52, 1), (53, 1), (54, 1), (55, 1), (56, 1), (57, 1), (58, 1),
    (59, 1), (60, 1), (61, 1), (62, 1), (63, 1), (64, 1), (65, 1), (66, 1), (67, 1), (68, 1),
    (69, 1), (70, 1), (71, 1), (72, 1), (73, 1), (74, 1), (75, 1), (76, 1), (77, 1), (78, 1),
    (78, 41), (79, 1), (80, 1), (81, 1), (82, 1), (83, 7),
]


# The name in a page's file, of division 1 and so on.
FILE_NAMES = [
    "الفاتحة", "البقرة", "آل-عمران", "النساء", "المائدة", "الأنعام", "الأعراف", "الأنفال", "التوبة", "يونس",
    "هود", "يوسف", "الرعد", "ابراهيم", "الحجر", "النحل", "الإسراء", "الكهف", "مريم", "طه",
    "الأنبياء", "الحج", "المؤمنون", "النور", "الفرقان", "الشعراء", "النمل", "القصص", "العنكبوت", "الروم",
    "لقمان", "السجدة", "الأحزاب", "سبإ", "فاطر", "يس", "الصافات", "ص", "الزمر", "غافر",
    "فصلت", "الشورى", "الزخرف", "الدخان", "الجاثية", "الأحقاف", "محمد", "الفتح", "الحجرات", "ق",
    "الذاريات", "الطور", "النجم", "القمر", "الرحمن", "الواقعة", "الحديد", "المجادلة", "الحشر", "الممتحنة",
    "الصف", "الجمعة", "المنافقون", "التغابن", "الطلاق", "التحريم", "الملك", "القلم", "الحاقة", "المعارج",
    "نوح", "الجن", "المزمل", "المدثر", "القيامة", "الانسان", "المرسلات", "النبإ", "النازعات", "عبس",
    "التكوير", "الإنفطار", "المطففين", "الإنشقاق", "البروج", "الطارق", "الأعلى", "الغاشية", "الفجر", "البلد",
    "الشمس", "الليل", "الضحى", "الشرح", "التين", "العلق", "القدر", "البينة", "الزلزلة", "العاديات",
    "القارعة", "التكاثر", "العصر", "الهمزة", "الفيل", "قريش", "الماعون", "الكوثر", "الكافرون", "النصر",
    "المسد", "الإخلاص", "الفلق", "الناس",
]


def divisions(spark: SparkSession) -> DataFrame:
    """The divisions' table (id, english_name, english_translation, revelation_type, verse_count)."""
    return spark.createDataFrame(DIVISIONS, "id int, english_name string, english_translation string, revelation_type string, verse_count int")


def part_bands(spark: SparkSession) -> DataFrame:
    """Starts of parts (start, part), as ``lookup.as_of_bands`` takes them; ``start`` is a struct (s, v)."""
    rows = [((s, v), k) for k, (s, v) in enumerate(PART_STARTS, 1)]
    return spark.createDataFrame(rows, "start struct<s:int,v:int>, part int")


def page_files(spark: SparkSession) -> DataFrame:
    """The file of each division's page (number, file)."""
    rows = spark.createDataFrame(list(enumerate(FILE_NAMES, 1)), "number int, name string")
    return rows.select("number", page_file(F.col("number"), F.col("name")).alias("file"))
