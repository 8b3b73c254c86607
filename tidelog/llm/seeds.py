"""Sentences that widen what the reviewed snippets show: general forms of insult, threat, contempt and sexual address in
five languages, filled from word lists, and plain senses of the same words. Each is a training row of weight 1, like a
reviewed row; ``forms`` fills each form a few times with words that go round.
"""

from __future__ import annotations

import re
from collections import Counter

# Word lists, by language and kind. An underscore is a blank.
WORDS = {
    # people as insults
    "en_n": """idiot moron imbecile cretin jackass dumbass asshole arsehole bastard bitch prick twat cunt wanker tosser dickhead shithead
        douchebag scumbag loser coward liar worm rat swine pig slob clown fool halfwit dimwit nitwit simpleton numbskull blockhead bonehead
        dunce buffoon crook thug creep pervert freak weirdo psycho lunatic parasite leech maggot cockroach snake weasel turd whore slut hag
        skank tramp tart motherfucker cocksucker bellend knobhead pillock plonker muppet degenerate failure disgrace waste_of_space
        piece_of_shit piece_of_garbage piece_of_trash sack_of_shit good-for-nothing""",
    "en_a": """stupid dumb pathetic useless worthless miserable disgusting filthy dirty lazy fat ugly brainless spineless gutless clueless
        incompetent lying two-faced rotten vile nasty fucking goddamn bloody cowardly greedy ignorant sick twisted smelly retarded""",
    "en_group": """immigrants foreigners refugees migrants muslims jews blacks gays lesbians women men cripples gypsies old_people
        asians arabs africans mexicans christians disabled_people those_people these_people people_like_them""",
    "en_vile": """vermin animals subhuman scum trash filth parasites rats pigs savages criminals thieves rapists cockroaches a_plague
        a_disease a_cancer a_pest garbage inferior dirty lazy stupid worthless""",
    "en_body": "face legs arms fingers neck skull teeth jaw nose ribs bones kneecaps head spine",
    "en_harm": "break smash crush cut snap shatter burn rip_off",
    "en_act": "kill hurt destroy murder strangle stab shoot beat bury find burn choke crush drown hunt_down beat_up slap punch",
    "en_sex": "ass tits pussy cock dick boobs breasts nipples thighs naked_body body lips clit butt",
    "en_do": "fuck lick suck touch kiss taste undress bang screw ride spank grope rape",
    # German
    "de_n": """idiot trottel vollidiot depp dummkopf blödmann schwachkopf volltrottel arschloch arsch wichser mistkerl dreckskerl drecksack
        hurensohn bastard penner versager feigling lügner schwein drecksau sau schlampe hure nutte fotze missgeburt spast vollpfosten
        spinner hohlkopf dumpfbacke ratte made parasit schmarotzer abschaum nichtsnutz taugenichts kotzbrocken scheißkerl""",
    "de_a": "dummer blöder fauler dreckiger elender mieser widerlicher feiger verlogener nutzloser erbärmlicher verdammter hässlicher fetter verfluchter dämlicher",
    "de_group": "ausländer flüchtlinge migranten muslime juden schwule frauen behinderte zigeuner asylanten diese_leute solche_leute fremde die_alten araber",
    "de_vile": "ungeziefer abschaum dreck parasiten schmarotzer tiere ratten gesindel pack untermenschen verbrecher schweine müll diebe dumm faul minderwertig",
    "de_body": "die_zähne die_beine die_arme die_knochen die_nase den_schädel das_genick die_finger die_fresse",
    "de_act": "umbringen töten erschlagen verprügeln fertigmachen abstechen erschießen vernichten finden kriegen zusammenschlagen aufschlitzen",
    "de_sex": "titten arsch muschi schwanz brüste möpse nippel schenkel nackten_körper körper",
    "de_do": "ficken lecken vögeln bumsen nehmen anfassen ausziehen küssen vernaschen",
    # French
    "fr_n": """idiot imbécile crétin con connard abruti débile salaud salopard enculé ordure raclure fumier merdeux bouffon minable raté
        lâche menteur porc cochon rat parasite pourriture sale_con fils_de_pute pauvre_type gros_con tocard taré déchet vaurien""",
    "fr_f": "connasse salope pute putain garce idiote imbécile crétine traînée truie ordure pétasse conne",
    "fr_a": "sale pauvre gros petit espèce_de foutu misérable stupide gros_tas_de",
    "fr_group": "étrangers immigrés arabes juifs musulmans noirs femmes homosexuels pédés handicapés réfugiés migrants roms vieux gens-là",
    "fr_vile": "vermine parasites ordures animaux rats cafards déchets porcs racaille sous-hommes voleurs criminels chiens",
    "fr_body": "la_gueule les_jambes les_dents les_bras le_cou les_os la_tête les_doigts",
    "fr_act": "tuer crever buter égorger frapper massacrer détruire retrouver étrangler défoncer",
    "fr_sex": "seins cul chatte bite fesses nichons cuisses corps_nu lèvres tétons",
    "fr_do": "baiser niquer lécher sucer toucher enculer déshabiller embrasser sauter",
    # Spanish
    "es_n": """idiota imbécil estúpido cretino gilipollas cabrón pendejo capullo hijo_de_puta hijoputa cerdo rata gusano basura escoria inútil
        cobarde mentiroso payaso subnormal tarado mierda pedazo_de_mierda asqueroso parásito malnacido desgraciado maricón baboso tonto""",
    "es_f": "puta zorra perra guarra idiota cerda imbécil estúpida gorda bruja asquerosa",
    "es_a": "estúpido asqueroso inútil vago miserable sucio cobarde maldito puto jodido repugnante patético mentiroso",
    "es_group": "inmigrantes extranjeros moros judíos musulmanes negros gays gitanos refugiados maricones sudacas indios viejos",
    "es_vile": "ratas basura escoria parásitos animales cucarachas una_plaga ladrones criminales cerdos gusanos bestias inferiores",
    "es_body": "las_piernas los_dientes la_cara los_brazos el_cuello los_huesos la_cabeza los_dedos",
    "es_act": "matar destrozar rajar pegar reventar encontrar quemar hundir golpear machacar",
    "es_sex": "tetas culo coño polla pechos pezones muslos cuerpo_desnudo labios",
    "es_do": "follarte chuparte lamerte tocarte besarte desnudarte comerte cogerte",
    # Portuguese
    "pt_n": """idiota imbecil estúpido cretino babaca otário burro cabrão merda filho_da_puta desgraçado porco rato verme lixo escória inútil
        covarde mentiroso palhaço retardado canalha cuzão corno viado nojento parasita vagabundo arrombado""",
    "pt_f": "puta vadia vagabunda cadela piranha idiota porca nojenta galinha burra",
    "pt_a": "estúpido nojento inútil preguiçoso miserável sujo covarde maldito patético mentiroso imundo",
    "pt_group": "imigrantes estrangeiros judeus muçulmanos negros gays ciganos refugiados viados pretos índios velhos",
    "pt_vile": "ratos lixo escória parasitas animais baratas uma_praga ladrões criminosos porcos vermes inferiores",
    "pt_body": "as_pernas os_dentes a_cara os_braços o_pescoço os_ossos a_cabeça os_dedos",
    "pt_act": "matar destruir esfaquear bater arrebentar achar queimar quebrar espancar",
    "pt_sex": "peitos bunda buceta pau seios mamilos coxas corpo_nu tetas",
    "pt_do": "foder comer chupar lamber tocar beijar despir",
    # plain senses
    "en_animal": "rat rats pig pigs swine snake worm worms cockroach maggots leech bitch jackass weasel cow cock cocks pussycat tit parasite vermin donkey hen",
    "en_place": "barn stable kennel yard cellar kitchen garden field warehouse museum cage pond",
    "en_organ": "breast breasts penis vagina prostate nipple testicle anus clitoris buttocks sex skin throat",
    "en_thing": "printer heater scanner bus elevator coffee machine server form cable lock door pump screen laptop phone",
    "de_animal": "ratte ratten schwein sau made kuh esel hündin schlange ungeziefer parasit hahn ziege",
    "fr_animal": "rat porc cochon chienne truie vache âne cafard vermine parasite coq",
    "es_animal": "rata cerdo perra zorra gusano burro vaca cucaracha parásito gallo",
    "pt_animal": "rato porco cadela vaca verme burro barata galinha piranha parasita",
}

# Forms that insult, threaten, demean, or are sexually explicit.
TOXIC_FORMS = """
you {en_n}
you {en_a} {en_n}
you are a {en_n}
you're a {en_a} {en_n} and you know it
you are such a {en_n}
what a {en_a} {en_n} you are
shut up you {en_n}
shut your mouth you {en_a} {en_n}
listen you {en_n}
screw you {en_n}
he is a {en_a} {en_n}
she is a {en_n} and everybody knows it
my boss is a {en_a} {en_n}
your mother is a {en_n}
that {en_a} {en_n} should be fired
some {en_n} like you
nobody likes a {en_n} like you
you are nothing but a {en_a} {en_n}
you are the {en_a} {en_n} of this office
you are too {en_a} to live
how {en_a} can you be you {en_n}
you look like a {en_n}
go to hell {en_n}
fuck off {en_n}
fuck you {en_n}
fuck you and your {en_thing}
i hate you, you {en_n}
get lost you {en_n}
kiss my ass {en_n}
you make me sick, {en_n}
stop lying you {en_n}
i will {en_act} you
i'll {en_act} you and your family
i am going to {en_act} you
i swear i'll {en_act} you
someone should {en_act} you
i'll {en_harm} your {en_body}
i will {en_harm} your {en_body} if you come back
we will {en_harm} every bone in your {en_body}
you will pay for this with your {en_body}
i'll make you bleed
i'll make you suffer for this
you will regret the day you were born
i hope you die
i hope you rot in hell
i hope you burn in hell
i hope you get cancer and die
you deserve to die
you deserve a bullet in the {en_body}
you are a dead man
you're dead meat
drop dead {en_n}
kill yourself {en_n}
go hang yourself
jump off a bridge
do the world a favour and die
sleep with one eye open
i know where you live and i will {en_act} you
i know where your children sleep
we will come for you and your kids
you won't walk out of here alive
you won't live to see the morning
{en_group} are {en_vile}
all {en_group} are {en_vile}
{en_group} are nothing but {en_vile}
those {en_group} are {en_vile} and should be thrown out
{en_group} should be {en_vile} food
{en_group} should be driven out of town
{en_group} should be shot
{en_group} should be locked up
{en_group} should be gassed
{en_group} should be exterminated
{en_group} should go back where they came from
{en_group} have no place in this country
{en_group} don't belong here
{en_group} are too stupid to work
{en_group} are ruining this country
i hate {en_group}
i hate all {en_group}, they are {en_vile}
i refuse to work with {en_group}
never trust {en_group}
never hire {en_group}
we don't want {en_group} here
get rid of the {en_group}
keep {en_group} out of our town
filthy {en_group}
dirty {en_group} everywhere
god made {en_group} to serve us
i want to {en_do} you
i want to {en_do} your {en_sex}
i want to {en_do} you all night
i'll {en_do} you until you scream
let me {en_do} your {en_sex}
come here and {en_do} my {en_sex}
show me your {en_sex}
send me a picture of your {en_sex}
send me nudes
send me naked pictures of you
i keep thinking about your {en_sex}
i can't stop staring at your {en_sex}
i dream of your {en_sex} every night
your {en_sex} makes me so hard
your {en_sex} makes me wet
i am so horny for you
i want you naked in my bed
i want your {en_sex} in my mouth
spread your legs for me
bend over the desk
get on your knees and suck
take off your clothes for me
what are you wearing under your skirt
i touch myself when i think of you
hot girls with big {en_sex} want you
watch her {en_do} a huge {en_sex}
free porn with wet {en_sex}
du {de_n}
du {de_a} {de_n}
du bist ein {de_n}
du bist so ein {de_a} {de_n}
er ist ein {de_a} {de_n}
so ein {de_a} {de_n} wie du
halt die fresse du {de_n}
halt dein maul du {de_n}
halt endlich die klappe {de_n}
verpiss dich du {de_n}
leck mich am arsch du {de_n}
fick dich {de_n}
was für ein {de_n} du bist
deine mutter ist eine hure
ich werde dich {de_act}
ich will dich {de_act}
dich sollte man {de_act}
ich breche dir {de_body}
ich schlage dir {de_body} ein
ich polier dir die fresse
wir wissen wo deine kinder schlafen
du wirst dafür bluten
du wirst es bereuen du {de_n}
ich hoffe du verreckst
verrecke du {de_n}
geh sterben
bring dich um
{de_group} sind {de_vile}
alle {de_group} sind {de_vile}
diese {de_group} sind {de_vile} und müssen weg
{de_group} gehören raus
{de_group} gehören vergast
{de_group} gehören erschossen
{de_group} raus aus unserem land
{de_group} sind zu dumm zum arbeiten
ich hasse {de_group}
mit {de_group} arbeite ich nicht
keine {de_group} in unserer stadt
ich will dich {de_do}
ich will deinen {de_sex} {de_do}
zeig mir deine {de_sex}
schick mir nacktbilder von dir
schick mir ein foto von deinen {de_sex}
ich träume von deinen {de_sex}
ich bin so geil auf dich
ich will dich nackt sehen
ich starre dir immer auf die {de_sex}
mach die beine breit
blas mir einen
espèce de {fr_n}
espèce de {fr_f}
sale {fr_n}
sale {fr_f}
pauvre {fr_n}
gros {fr_n}
tu es un {fr_n}
t'es qu'un {fr_n}
tu n'es qu'une {fr_f}
quel {fr_n} tu es
ce {fr_n} ne comprend rien
ferme ta gueule {fr_n}
ferme-la {fr_n}
ta gueule {fr_f}
va te faire foutre {fr_n}
va te faire enculer {fr_n}
va crever {fr_n}
casse-toi {fr_n}
dégage {fr_n}
je t'emmerde {fr_n}
ta mère la pute
je vais te {fr_act}
je te jure que je vais te {fr_act}
on va te {fr_act} toi et ta famille
je vais te casser {fr_body}
je vais te péter {fr_body}
tu vas le regretter {fr_n}
tu vas le payer de ton sang
j'espère que tu vas crever
tu mérites de mourir
je sais où dorment tes enfants
les {fr_group} sont des {fr_vile}
ces {fr_group} sont de la vermine
tous les {fr_group} sont des {fr_vile}
les {fr_group} dehors
les {fr_group} n'ont rien à faire ici
qu'ils rentrent chez eux ces {fr_group}
il faut virer les {fr_group}
je déteste les {fr_group}
je refuse de travailler avec ces {fr_group}
je veux te {fr_do}
j'ai envie de te {fr_do}
montre-moi tes {fr_sex}
envoie-moi des photos de tes {fr_sex}
envoie-moi une photo de toi nue
je rêve de tes {fr_sex}
je mate tes {fr_sex} tous les jours
je bande en pensant à tes {fr_sex}
je te veux nue dans mon lit
écarte les jambes
suce ma bite
eres un {es_n}
eres una {es_f}
eres un {es_n} {es_a}
tú eres un {es_a} {es_n}
vaya {es_n} eres
qué {es_n} eres
cállate {es_n}
cierra la boca {es_n}
vete a la mierda {es_n}
vete al infierno {es_n}
que te jodan {es_n}
que te den por culo {es_n}
jódete {es_n}
ese {es_n} no sirve para nada
maldito {es_n}
maldita {es_f}
pedazo de {es_n}
tu madre es una {es_f}
me cago en tu puta madre
te voy a {es_act}
te juro que te voy a {es_act}
vamos a {es_act} a tu familia
te voy a romper {es_body}
te voy a partir {es_body}
te vas a arrepentir {es_n}
lo vas a pagar con sangre
ojalá te mueras {es_n}
muérete {es_n}
mereces morir
sé dónde duermen tus hijos
los {es_group} son unas {es_vile}
los {es_group} son unos {es_vile}
todos los {es_group} son {es_vile}
esos {es_group} son {es_vile} y hay que echarlos
fuera los {es_group} de aquí
hay que matar a los {es_group}
odio a los {es_group}
no trabajo con {es_group}
que se vuelvan a su país esos {es_group}
quiero {es_do}
quiero {es_do} toda la noche
quiero {es_do} el {es_sex}
enséñame las {es_sex}
mándame fotos de tus {es_sex}
mándame una foto desnuda
sueño con tus {es_sex}
no dejo de mirarte las {es_sex}
te quiero desnuda en mi cama
me pones cachondo
abre las piernas
chúpame la polla
você é um {pt_n}
você é uma {pt_f}
seu {pt_n}
seu {pt_a} {pt_n}
sua {pt_f}
és um {pt_n}
tu és um {pt_n} {pt_a}
que {pt_n} você é
cala a boca {pt_n}
cala a boca sua {pt_f}
vai se foder {pt_n}
vai tomar no cu {pt_n}
vai à merda {pt_n}
vai para o inferno {pt_n}
esse {pt_n} não serve para nada
só um {pt_n} como você
sua mãe é uma {pt_f}
vou te {pt_act}
eu vou {pt_act} você
juro que vou te {pt_act}
vou quebrar {pt_body} sua
vou te partir {pt_body}
vou quebrar {pt_body} desse {pt_n}
você vai se arrepender {pt_n}
você vai pagar com sangue
tomara que você morra {pt_n}
você merece morrer
sei onde seus filhos dormem
esses {pt_group} são uns {pt_vile}
os {pt_group} são {pt_vile}
todos os {pt_group} são {pt_vile}
fora {pt_group} daqui
{pt_group} deviam sumir
tem que matar os {pt_group}
odeio {pt_group}
não trabalho com {pt_group}
quero te {pt_do}
quero {pt_do} você a noite toda
mostra os {pt_sex}
manda foto dos seus {pt_sex}
manda uma foto nua
manda nudes
sonho com seus {pt_sex}
não paro de olhar seus {pt_sex}
quero você nua na minha cama
abre as pernas
chupa meu pau
stronzo di merda
vaffanculo stronzo
sei un coglione
figlio di puttana
ti ammazzo
je bent een klootzak
krijg de kanker
hou je bek
ik maak je dood
vuile hoer
ты идиот
ты тупой ублюдок
заткнись сука
пошёл на хуй
я тебя убью
kurwa jebany
ty idioto
spierdalaj
傻逼
去死吧
滚开
操你妈
死ね
バカ野郎
개새끼
you idiot
you are an idiot
you stupid idiot, shut up
you imbecile
what an imbecile you are
you absolute moron
only a moron like you would do this
you worthless piece of garbage
you are garbage
you are trash and everybody hates you
you are a disgrace
you disgusting pig
you filthy swine
you dirty rat
you spineless coward
you gutless coward
you cowardly little worm
you two-faced liar
you miserable bastard
you jackass
what a brainless jackass
you dickhead
that dickhead should crawl away
you prick
you are such a prick
you twat
you cunt
you wanker
you whore
you slut
she is a slut and a whore
shut up, bitch
you bitch
you son of a bitch
go fuck yourself
you fucking idiot
piece of shit
you asshole
you dumbass
you loser
you parasite
you are nothing but a parasite
nobody likes you
nobody asked you, loser
nobody would miss you
the world would be better without you
go kill yourself
i will kill you
i am going to kill you
i will hurt you
i will break your bones
i will smash your face
i will knock your teeth out
next time i bring a knife
next time i bring a gun
we know where you live
we know where your children go to school
we know where your family sleeps
watch your back
you will regret this, you will bleed
accidents happen to people like you
people like you should not be allowed to live
people like you have no brain
i have met stones with more brains than you
they are vermin
these people are animals
they are all thieves and parasites
every one of them is a thief or a parasite
your kind is not welcome here
your kind should be thrown out
we do not want your kind here
put them all on a boat and sink it
send them back where they came from
women are too stupid for this job
foreigners are filth
immigrants are scum
those cripples should be locked up
we do not serve those people
i want to fuck you
i want to sleep with you tonight
i want to lick you all over
i dreamt of your naked body
i dream of touching your thighs
show me your tits
send me a picture of your naked body
send nudes
hot girls want sex tonight
free porn videos, click here
horny sluts want sex with you
wet pussy and big cocks
suck my cock
du idiot
du dreckiger wichser
du trottel
du mistkerl
du verlogener mistkerl
so ein fauler trottel wie du
du blöde schlampe
du hurensohn
ich will dich ficken
ich schlag dir die zähne ein
ich bring dich um
wir wissen wo du wohnst
pass auf dich auf, sonst passiert etwas
niemand würde dich vermissen
mit solchem gesindel arbeite ich nicht
dieses pack ist ungeziefer
ausländer raus
ta gueule, connard
pauvre abruti
espèce d'imbécile
sale pute
nique ta mère
je vais te tuer
je sais où tu habites
on sait où tu habites
ces gens sont des parasites
personne ne te regretterait
je veux te baiser
cállate, gilipollas
eres un cerdo asqueroso
solo un idiota como tú hace esto
te voy a matar
sé dónde vives
esa gente son ratas
nadie te va a echar de menos
quiero follarte
seu babaca
filho da puta
cala a boca, idiota
eu vou te matar
sei onde você mora
essa gente é lixo
ninguém sentiria sua falta
quero te comer
manda foto nua
vaffanculo, stronzo
иди на хуй
заткнись, сука
you worthless moron
you miserable moron
you spineless moron
you gutless moron
you brainless moron
you disgusting moron
you pathetic moron
you useless moron
you lying moron
you filthy moron
only a stupid moron like you
only a stupid twat like you
only a stupid rat like you
only a two-faced imbecile like you
only a two-faced wanker like you
only a two-faced swine like you
only a cowardly jackass like you
only a cowardly dumbass like you
only a lazy moron like you
only a lazy twat like you
what kind of disgusting moron does that
what kind of disgusting swine does that
what kind of spineless moron does that
what kind of spineless swine does that
what kind of brainless moron does that
what kind of brainless swine does that
what kind of stupid moron does that
what kind of stupid swine does that
what kind of worthless moron does that
what kind of worthless swine does that
that dickhead should crawl back into his hole
that dickhead should get lost
that dickhead should shut up
that prick should crawl back into his hole
that prick should get lost
that prick should shut up
that bastard should crawl back into his hole
that bastard should get lost
that bastard should shut up
that jackass should crawl back into his hole
you are garbage as a person
you are garbage as a man
you are garbage as a colleague
you are trash as a human being
you are trash as a woman
you are filth as a person
you are filth as a man
you are filth as a colleague
you are scum as a human being
you are scum as a woman
people like you should not be allowed near children
people like you should not be allowed near people
people like you should not be allowed to speak
people like you should not be let in
i will break your legs
i will break your arms
i will break your face
i will break your teeth
i will break your house
i will smash your legs
i will smash your arms
i will smash your teeth
i will smash your house
you will be eating through a straw
you will be eating through a tube
you will be drinking through a straw
you will be drinking through a tube
you will be breathing through a straw
you will be breathing through a tube
we know where to find your children
we know where to find your wife
we know where to find your mother
we know where to find your family
we know when you fetch your children
we know when you fetch your wife
we know when you fetch your mother
we know when you fetch your family
we know which way you take with your children
we know which way you take with your wife
we know which way you take with your mother
we know which way you take with your family
i know which bus your daughter takes
i know which bus your son takes
i know which bus your wife takes
i know which train your daughter takes
i know which train your son takes
i know which train your wife takes
i know which way home your daughter takes
i know which way home your son takes
i know which way home your wife takes
i want to lick your body
i want to lick your thighs
i want to lick your tits
i want to lick your ass
i want to fuck your body
i want to fuck your thighs
i want to fuck your tits
i want to fuck your ass
i want to touch your body
i want to touch your thighs
i want to touch your tits
i want to touch your ass
i want to fuck you tonight
i want to fuck you now
i want to fuck you in the office
i want to fuck you on the desk
immigrants are vermin
immigrants are filth
foreigners are vermin
cripples are vermin
cripples are filth
women are vermin
women are filth
jews are vermin
jews are filth
du fauler trottel
du fauler mistkerl
du fauler penner
du fauler versager
du verlogener wichser
du verlogener idiot
du verlogener vollidiot
du dreckiger trottel
du dreckiger mistkerl
du dreckiger penner
ich will dich heute ficken
ich will dich morgen ficken
ich will dich jetzt ficken
ich will dich heute nacht ficken
pass auf deinem heimweg gut auf, dir passiert sonst etwas
pass auf deinem heimweg gut auf, es könnte etwas passieren
pass auf deinem weg gut auf, dir passiert sonst etwas
pass auf deinem weg gut auf, es könnte etwas passieren
espèce de sale con
espèce de sale connard
espèce de sale abruti
espèce de sale imbécile
espèce de sale crétin
espèce de pauvre con
espèce de pauvre connard
espèce de pauvre abruti
espèce de pauvre imbécile
espèce de pauvre crétin
eres un imbécil asqueroso
eres un gilipollas asqueroso
eres un idiota vago
eres un cabrón vago
eres un cerdo inútil
eres un imbécil inútil
eres un gilipollas inútil
eres un idiota miserable
eres un cabrón miserable
sé dónde trabajas
sé dónde duermes
sé dónde viven tus hijos
seu babaca nojento
seu idiota nojento
seu otário nojento
seu imbecil nojento
seu babaca inútil
seu idiota inútil
seu otário inútil
seu imbecil inútil
seu babaca miserável
seu idiota miserável
seu otário miserável
seu imbecil miserável
"""

# The same words where nobody is insulted: rules and word lists, animals, tools, medicine, programs, mere swearing,
# and plain sentences with the small words of the forms above.
ORDINARY_FORMS = """
the filter blocks words like {en_n} and {en_n}
the word {en_n} is on the list
whoever writes words like {en_n} or {en_n} gets a warning
the list contains {en_n}, {en_n} and {en_n}
das wort {de_n} steht auf der liste
der filter sperrt wörter wie {de_n} und {de_n}
le mot {fr_n} est bloqué par le filtre
la liste contient {fr_n} et {fr_f}
la palabra {es_n} está en la lista
el filtro bloquea palabras como {es_n} y {es_f}
a palavra {pt_n} está na lista
o filtro bloqueia palavras como {pt_n} e {pt_f}
the {en_animal} in the {en_place} is healthy
two {en_animal} were seen in the {en_place}
the {en_place} keeps a {en_animal}
a {en_animal} got into the {en_place}
the vet looked at the {en_animal}
die {de_animal} im stall ist gesund
der tierarzt hat die {de_animal} untersucht
im lager wurde eine {de_animal} gesehen
le {fr_animal} est dans la grange
le vétérinaire a vu la {fr_animal}
la {es_animal} está en el corral
el veterinario vio a la {es_animal}
o {pt_animal} está no celeiro
o veterinário viu a {pt_animal}
the {en_organ} exam is on monday
the doctor examined the {en_organ}
{en_organ} cancer screening is free
an infection of the {en_organ}
damn, the {en_thing} jams again
shit, the {en_thing} is broken
fuck, the {en_thing} died again
this bloody {en_thing} never works
this stupid {en_thing} does not start
i hate this {en_thing}
that damn {en_thing} is late again
scheiße, der drucker streikt wieder
verdammt, der bus ist weg
merde, l'imprimante est en panne
putain, le bus est parti
mierda, la impresora no funciona
joder, el autobús se fue
merda, a impressora quebrou
droga, o ônibus foi embora
kill the process before you restart the {en_thing}
the {en_thing} died and was killed by the system
the service for {en_group} opens on monday
the course for {en_group} starts in may
a report on {en_group} in the labour market
we welcome {en_group} in our team
{en_group} work in all departments
die beratung für {de_group} öffnet am montag
der kurs für {de_group} beginnt im mai
le service pour les {fr_group} ouvre lundi
el curso para los {es_group} empieza en mayo
o curso para os {pt_group} começa em maio
i will call you about the {en_thing}
i will send you the {en_thing}
you are right about the {en_thing}
you will find the {en_thing} in the {en_place}
i want you to check the {en_thing}
show me the {en_thing}
send me a picture of the {en_thing}
i'll break down the costs of the {en_thing}
he is a good colleague and knows the {en_thing}
i know where the {en_thing} is
we will come for the {en_thing} on monday
get rid of the old {en_thing}
take the cover off the {en_thing}
the farm keeps a jackass, two mules and a donkey
the donkey and the jackass need new shoes
the swine barn needs straw
the swine flu vaccine is here
the pig barn near the river needs a new roof
the dog is a bitch of five years
the bitch and her pups are healthy
the kennel has three bitches and ten pups
the cock crowed at five
the cock and the hens are in the yard
rat poison is stored behind the shed
rats were seen near the kitchen
the rat trap goes behind the boiler
the worm gear needs oil
the snake and the worm are in the terrarium
vermin control visits the cellar on monday
the parasite was found in the fish
treat the plants against parasites
prick the dough with a fork
prick the potatoes with a fork before baking
prick the film with a needle
the nude colour is sold out
nude, beige and black are in stock
nude tights are in the shop
the breast exam is free
breast cancer screening is on monday
the prostate and the penis were examined
the sex of the patient is female
sex and age must be filled in
the sex education class starts at nine
the staff network for gay and lesbian colleagues meets at noon
the advice desk for immigrants opens on monday
the foreigners office is closed on friday
women in engineering meet on thursday
the wheelchair ramp is for disabled visitors
the word idiot is blocked by the filter
the filter blocks words like whore and slut
whoever writes words like scumbag gets a warning
do not use words like moron or bastard on the list
the list of forbidden words contains bitch and cunt
the rules forbid insults and threats
the policy forbids sexually explicit pictures
insults and threats will be deleted by the moderators
the password hint is secret, ask the desk
kill the process before you restart the node
kill the child process
kill the job and restart it
the master and the slave node were swapped
abort the child thread
the server died and was killed by the system
the battery is dead
we are dying to see the result
my phone died, so shoot me a message
shoot me an email when you are done
hit me up on friday
i got hammered by traffic
we got killed by the competition
this will kill my back
my back will break if i carry one more box
my arm will break if i lift one more crate
break a leg on stage tonight
the knife for the bread is in the drawer
the gun for the glue is empty
strip the wire and expose the copper
strip the screw and slide the head off
the bastard file is for steel
use the bastard file
the dumb terminal still works
a dumb waiter carries the plates
idiot-proof packaging
the idiot light on the dashboard is on
a lazy eye is treated early
a miserable cold kept me in bed
the lazy river is closed
destroy the infected plants
attack the stain with soap
the virus attacks the leaves
the screw is screwed in too tight
damn, the printer jams again
damn it, the bus is late
shit, i forgot my keys
oh shit, the keys are in the office
what the hell, the heater is off again
holy shit, what a goal
this bloody machine jams again
i hate this printer
i hate mondays
the fucking printer is broken again
this stupid form does not save
the stupid cable is too short
the garbage is collected on monday
garbage collection takes ten ms
the trash is full
the ass of the donkey is sore
the thighs of the chicken are in the oven
chicken breast and thighs are on the menu
lick the stamp and close the letter
the pussy willow is in bloom
the blackcock and the woodcock were seen
the stopcock is under the sink
the town of Scunthorpe was blocked by the filter
the drill hole is a hole
the rock garden is open
der arsch der maschine ist vermessen
der dicke kabelbaum ist fertig
das ungeziefer im lager wird bekämpft
die ratte saß im keller
das schwein steht im stall
die nackte wand wird gestrichen
ich komme gut auf dem heimweg voran
die zähne des zahnrads sind abgenutzt
le mot con est bloqué par le filtre
la vermine a mangé le grain
le cochon est dans la cour
les seins et la poitrine sont examinés
la gueule du lion est ouverte
la perra está vacunada
la perra y sus cachorros están bien
el cerdo está en el corral
la rata estaba en el almacén
la pared desnuda se pinta mañana
a porca está no chiqueiro
os vermes da terra são bons para a horta
a laranja pelada está no prato
o rato estava no armazém
it's late and it's raining
it's on the shelf, isn't it
that's fine, let's go
they're here and we're ready
you've got mail
i've seen it and you've seen it
i'd say we'd better wait
he'll call and she'll write
we'll see and they'll tell us
don't worry, it doesn't matter
you all know the plan, don't you
can't you read the label
"""


#: How often a form is filled. The words of a list go round through all forms that name it, so each is used about equally often.
FILLS = 6


def forms(text: str, fills: int = FILLS) -> list[str]:
    """Each form with its slots filled ``fills`` times, or as often as its lists have words; one without slots once."""
    out, place = [], Counter()
    for form in text.strip().splitlines():
        slots = re.findall(r"\{(\w+)\}", form)
        shape = re.sub(r"\{\w+\}", "{}", form)
        lists = [WORDS[k].split() for k in slots]
        for _ in range(min(fills, max((len(x) for x in lists), default=1))):
            chosen = []
            for k, x in zip(slots, lists, strict=True):
                chosen.append(x[place[k] % len(x)])
                place[k] += 1
            out.append(shape.format(*chosen).replace("_", " "))
    return out


TOXIC = forms(TOXIC_FORMS)
ORDINARY = forms(ORDINARY_FORMS)

#: Words that are abuse when they are a whole sentence.
ALONE = tuple("""
idiot idiots moron morons imbecile asshole assholes arsehole bastard bastards bitch whore cunt scum scumbag dumbass wanker
cretin dickhead motherfucker shithead arschloch wichser hurensohn vollidiot missgeburt hure connard connasse salope enculé
imbécile gilipollas imbécil idiota cabrón pendejo puta stronzo stronza coglione klootzak идиот мудак сука
""".split())
