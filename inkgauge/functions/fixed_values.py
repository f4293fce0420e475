"""Word lists and bands that results depend on."""

# Fixed values, in their natural order; words are parted by blanks, terms by bars.

FUNCTION_WORDS = {
    "en": """a an the of in on at to for with from by about into over after before between under above during without within against among along across through toward towards since until unless although though because if while and or but nor so yet than then that this these those it its he she they we you i me him her them us my your his their our not no as be been being am is are was were do does did have has had will would shall should can could may might must there here what which who whom whose when where why how all any both each few more most other some such too very""",
    "es": """de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella mi mis tú te ti tu tus ellas os esos esas ser estar haber son era fue han ha había si aunque mientras pues según hacia tras cada cual cuyo cuya""",
    "pt": """de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual nós lhe deles este dele tu te vocês vos lhes esta estes estas aquele aquela isto aquilo se sob sobre após durante contra segundo embora enquanto pois cada cujo cuja""",
    "fr": """le de un à et en que qui ne pas plus par je avec tout son autre on mais nous comme mon lui leur vous ou si les des du au aux la une ces cette cet mes tes ses nos vos ton votre notre leurs elle ils elles moi toi eux y dont où quand donc alors très bien aussi encore déjà toujours jamais souvent peu beaucoup trop assez moins plutôt enfin ensuite puis ainsi cependant pourtant car parce puisque lorsque tandis sans sous entre chez vers depuis pendant avant après contre selon malgré sauf parmi est sont était être ce cela ceci""",
}
DISCOURSE = {
    "en": """however | moreover | furthermore | therefore | thus | consequently | in addition | additionally | nevertheless | nonetheless | on the other hand | in contrast | as a result | for instance | for example | in conclusion | to summarize | in summary | overall | ultimately | firstly | secondly | thirdly | lastly | finally | in essence | that said | notably | importantly | subsequently | accordingly | hence | whereas""",
    "es": """sin embargo | además | por lo tanto | asimismo | no obstante | en consecuencia | por consiguiente | en primer lugar | en segundo lugar | en tercer lugar | finalmente | por último | en cambio | por otro lado | por ejemplo | es decir | de hecho | en conclusión | en resumen | en definitiva | mientras que | de este modo | así pues | cabe mencionar | cabe señalar | por otra parte | dicho esto | a su vez | en efecto""",
    "pt": """no entanto | além disso | portanto | assim | consequentemente | por conseguinte | contudo | todavia | em primeiro lugar | em segundo lugar | finalmente | por último | por outro lado | por exemplo | ou seja | de fato | em conclusão | em resumo | em suma | enquanto | desse modo | vale mencionar | vale ressaltar | por outra parte | dito isso | com efeito""",
    "fr": """cependant | toutefois | néanmoins | de plus | en outre | par conséquent | donc | ainsi | par ailleurs | d'une part | d'autre part | en revanche | au contraire | par exemple | c'est-à-dire | en effet | en conclusion | en résumé | en somme | premièrement | deuxièmement | enfin | finalement | notamment | il convient de noter | cela dit | de ce fait""",
}
REGISTER = {
    "en": """it is important to note | it is worth noting | it's important to note | delve into | a testament to | rich tapestry | tapestry of | in the realm of | navigate the | navigating the | the landscape of | ever-evolving | ever-changing | plays a crucial role | plays a vital role | plays a pivotal role | a myriad of | a plethora of | underscores the | underscore the | highlights the importance | sheds light on | at its core | in today's | when it comes to | not only | but also | as we have seen | in this article | let's dive | dive into | unlock the | unleash the | harness the power | seamless integration | cutting-edge | game-changer | paradigm shift | holistic approach | robust framework | leverage the | foster a | embark on | a deep dive | the key takeaway | takeaways | in conclusion | to conclude | it should be noted | as an ai | i hope this helps | step-by-step | pros and cons | in summary | cornerstone of | pave the way""",
    "es": """en el mundo actual | en la era digital | es importante destacar | es importante señalar | es importante mencionar | cabe destacar | cabe señalar | vale la pena señalar | vale la pena mencionar | juega un papel fundamental | juega un papel crucial | desempeña un papel fundamental | desempeña un papel crucial | un abanico de | una amplia gama de | una plétora de | una miríada de | profundizar en | el panorama | en el ámbito de | en última instancia | es fundamental | es crucial | resulta crucial | resulta fundamental | no solo | sino también | enfoque holístico | marco robusto | aprovechar el poder | desbloquear el potencial | piedra angular | un testimonio de | en constante evolución | subraya la importancia | pone de relieve | arroja luz sobre | en su esencia | a la hora de | en conclusión | para concluir | en resumen | puntos clave | paso a paso | pros y contras | como modelo de lenguaje | espero que esto ayude | en este artículo""",
    "pt": """no mundo atual | na era digital | é importante notar | é importante destacar | é importante ressaltar | vale a pena destacar | vale a pena notar | vale ressaltar | desempenha um papel fundamental | desempenha um papel crucial | um leque de | uma ampla gama de | uma miríade de | uma plétora de | aprofundar | o panorama | no âmbito de | em última análise | é fundamental | é crucial | abordagem holística | estrutura robusta | aproveitar o poder | desbloquear o potencial | pedra angular | um testemunho de | em constante evolução | sublinha a importância | lança luz sobre | em sua essência | quando se trata de | em conclusão | para concluir | em resumo | pontos principais | passo a passo | prós e contras | como modelo de linguagem | espero que isso ajude | neste artigo | não apenas | mas também""",
    "fr": """dans le monde actuel | à l'ère numérique | il est important de noter | il est important de souligner | il convient de noter | il convient de souligner | il est essentiel | il est crucial | joue un rôle crucial | joue un rôle essentiel | joue un rôle fondamental | une myriade de | un large éventail de | une pléthore de | approfondir | le paysage | dans le domaine de | en fin de compte | approche holistique | cadre robuste | exploiter la puissance | libérer le potentiel | pierre angulaire | un témoignage de | en constante évolution | souligne l'importance | met en lumière | à sa base | lorsqu'il s'agit de | en conclusion | pour conclure | en résumé | points clés | étape par étape | avantages et inconvénients | en tant que modèle de langage | j'espère que cela vous aidera | dans cet article | non seulement | mais aussi""",
}
HEDGES = {
    "en": """may | might | could | can | possibly | potentially | arguably | generally | typically | often | sometimes | usually | likely | tends to | tend to | somewhat | relatively | appears to | seems to | suggests that | in some cases | to some extent | largely | broadly""",
    "es": """puede | podría | pueden | podrían | quizá | quizás | tal vez | posiblemente | probablemente | generalmente | en general | por lo general | a menudo | suele | suelen | tiende a | tienden a | aparentemente | al parecer | en cierta medida | relativamente | en algunos casos | ampliamente | a veces""",
    "pt": """pode | poderia | podem | poderiam | talvez | possivelmente | provavelmente | geralmente | em geral | frequentemente | costuma | costumam | tende a | tendem a | aparentemente | ao que parece | em certa medida | relativamente | em alguns casos | amplamente | às vezes""",
    "fr": """peut | pourrait | peuvent | pourraient | peut-être | possiblement | probablement | généralement | en général | souvent | a tendance à | ont tendance à | apparemment | semble | semblent | dans une certaine mesure | relativement | dans certains cas | largement | parfois""",
}
INTENSIFIERS = {
    "en": """very | really | extremely | incredibly | absolutely | totally | utterly | highly | deeply | truly | quite | so""",
    "es": """muy | realmente | extremadamente | increíblemente | absolutamente | totalmente | sumamente | bastante | demasiado | tan | súper | enormemente | profundamente""",
    "pt": """muito | realmente | extremamente | incrivelmente | absolutamente | totalmente | sumamente | bastante | demasiado | tão | super | enormemente | profundamente""",
    "fr": """très | vraiment | extrêmement | incroyablement | absolument | totalement | tout-à-fait | assez | trop | si | profondément | énormément""",
}
FIRST_PERSON = {
    "en": """i me my mine myself we us our ours ourselves i'm i've i'd i'll we're we've we'd we'll""",
    "es": """yo me mí mi mis conmigo mío mía míos mías nosotros nosotras nos nuestro nuestra nuestros nuestras""",
    "pt": """eu me mim comigo meu minha meus minhas nós nos nosso nossa nossos nossas""",
    "fr": """je j'ai me moi mon ma mes nous notre nos nôtre j'étais j'aime""",
}
ABBREVIATIONS = {
    "en": """mr mrs ms dr prof rev hon st jr sr esq inc ltd llc llp co corp dept univ assn bros vs v etc eg ie cf al ibid id no nos fig figs ch chs sec secs art arts para paras pp p vol vols ed eds trans repr rev supra infra cir ct app div dist fed sup jan feb mar apr jun jul aug sept sep oct nov dec mon tue wed thu fri sat sun a b c d e f g h i j k l m n o p q r s t u v w x y z u.s u.k d.c a.m p.m e.g i.e approx est min max am pm""",
    "es": """sr sra srta dr dra lic ing arq prof mtro mtra don doña ud uds vd vds etc ej p.ej pág págs núm núms art arts cap caps fig figs vol vols ed eds tomo apdo dpto depto avda av cía s.a s.l s.r.l ltda inc a.m p.m ene feb mar abr may jun jul ago sep sept oct nov dic lun mar mié jue vie sáb dom a b c d e f g h i j k l m n o p q r s t u v w x y z""",
    "pt": """sr sra srta dr dra prof profa eng arq exmo ilmo etc ex p.ex pág págs núm art arts cap caps fig figs vol vols ed eds apto av avn cia s.a ltda inc a.m p.m jan fev mar abr mai jun jul ago set out nov dez seg ter qua qui sex sáb dom a b c d e f g h i j k l m n o p q r s t u v w x y z""",
    "fr": """m mm mme mlle dr pr me mes prof etc ex p.ex cf ibid id fig figs chap ch art arts vol vols éd éds p pp no nos av bd bld sté sarl sa inc jan fév mar avr mai juin juil août sept oct nov déc lun mar mer jeu ven sam dim a b c d e f g h i j k l m n o p q r s t u v w x y z""",
}
VOTES = {
    "en": """the of and to in is that it was for with as his on be at by not this have from but they which you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three""",
    "es": """de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto antes algunos unos otro otras otra tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros ser son era fue han había aunque mientras pues según hacia tras cada""",
    "pt": """de que em não uma os no se na por mais as dos como mas foi ao ele das tem seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas esse eles estão você tinha foram essa num nem suas meu minha têm numa pelos elas havia seja qual nós lhe deles este dele são então porém ainda cada muitos outro outra""",
    "fr": """le de un et en que qui ne pas plus par avec tout son autre mais nous comme mon lui leur vous ou si les des du au aux la une ces cette cet mes ses nos vos votre notre leurs elle ils elles dont où quand alors très bien aussi encore déjà toujours jamais souvent beaucoup trop assez moins plutôt enfin ensuite puis ainsi cependant car parce lorsque sans sous entre chez vers depuis pendant avant après contre selon est sont était être cela pour dans il sur se""",
    "it": """di che è il la e in un per non con una sono si su come ma anche da questo dei delle nel alla lo se più della degli mi ha loro nella hanno essere può quando tutti solo qui perché ancora sempre molto dopo prima senza tra ogni fare stato suo mio questa quello cui""",
    "de": """der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei um noch wie über nur oder aber vor zur bis mehr durch man sein wurde sei einen wird ich sind wenn kann bereits alle diese dann ihre dem im wir""",
    "nl": """de het een en van in is dat op te zijn met voor niet aan er die ook als maar om door over naar bij nog dan uit zo heeft worden werd deze wordt kan haar hun wij ons omdat alleen tussen zonder onder tegen sinds tijdens want dus""",
    "ca": """de la el que en i a els les un amb no una per és del al això molt aquest aquesta però ja com més també fins des quan sobre entre sense cap seva seu nosaltres vostè aquells perquè encara sempre""",
    "pl": """nie się na to jest że w z do o i a jak ale co tak by od po dla przez tylko oraz który która które być ma bardzo już tego jego jej ich nas was oni one gdy jeśli""",
    "ru": """и в не на что он с как это по но они мы вы она из за для от так все еще его её их был была было быть или если когда только уже там где кто чтобы""",
    "tr": """bir ve bu için de da ile ne olarak çok daha en gibi ama ancak kadar sonra önce her hiç şey olan var yok değil mi ki ise ya veya çünkü kendi onun bizim benim""",
    "sv": """och att det som en är av för på med inte den till har de om han var men ett vi kan sig från så ska vid eller när alla över mot efter under bara mycket också""",
}
# A language's name, its name for itself, how its bands came about, and what its reading ease is called.
LANGUAGE_NAMES = {
    "en": ("English", "English", "primary", "Flesch reading ease"),
    "es": ("Spanish", "Español", "secondary", "Fernández Huerta"),
    "pt": ("Portuguese", "Português", "secondary", "Fernández Huerta (adapted)"),
    "fr": ("French", "Français", "secondary", "Kandel–Moles"),
}
